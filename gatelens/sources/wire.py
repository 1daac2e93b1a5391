"""The radar's binary protocol: frames cut out of byte streams, reports decoded, commands encoded.

Fixed values of the protocol: reports run from F4 F3 F2 F1 to F8 F7 F6 F5,
commands and their replies from FD FC FB FA to 04 03 02 01; lengths are two
bytes, little-endian, and at most 128; type 01 is an engineering report.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT, REPORT_END = bytes.fromhex("F4F3F2F1"), bytes.fromhex("F8F7F6F5")
COMMAND, COMMAND_END = bytes.fromhex("FDFCFBFA"), bytes.fromhex("04030201")
MOST = 128
GATES = 9


class Cutter:
    """Whole payloads from bytes that come in any pieces. After damage it goes on behind the header alone."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> list[tuple[str, bytes]]:
        self.held += data
        out = []
        while True:
            at = min((i for i in (self.held.find(REPORT), self.held.find(COMMAND)) if i >= 0), default=-1)
            if at < 0:
                self.held = self.held[-3:]  # a header may have begun
                return out
            self.held = self.held[at:]
            if len(self.held) < 6:
                return out
            kind, end = ("report", REPORT_END) if self.held.startswith(REPORT) else ("reply", COMMAND_END)
            n = int.from_bytes(self.held[4:6], "little")
            if n > MOST:
                self.held = self.held[4:]
                continue
            if len(self.held) < n + 10:
                return out
            if self.held[6 + n : 10 + n] != end:
                self.held = self.held[4:]
                continue
            out.append((kind, self.held[6 : 6 + n]))
            self.held = self.held[10 + n :]


def report(payload: bytes) -> dict | None:
    """An engineering report's fields; None for another kind of payload or a short one."""
    if len(payload) < 17 + 2 * GATES or payload[0] != 0x01 or payload[1] != 0xAA:
        return None
    word = lambda i: int.from_bytes(payload[i : i + 2], "little")
    body = payload[13 : 13 + 2 * GATES]
    return {
        "status": payload[2], "moving_cm": word(3), "moving_energy": payload[5], "still_cm": word(6), "still_energy": payload[8],
        "distance_cm": word(9), "move": list(body[:GATES]), "still": list(body[GATES:]),
        "photo": payload[13 + 2 * GATES], "out": payload[14 + 2 * GATES], "device_occ": payload[2] != 0,
    }


def encode_report(status: int, moving_cm: int, moving_energy: int, still_cm: int, still_energy: int, distance_cm: int, move: list[int], still: list[int], photo: int = 0, out: int = 0) -> bytes:
    w = lambda v: v.to_bytes(2, "little")
    body = bytes([1, 0xAA, status]) + w(moving_cm) + bytes([moving_energy]) + w(still_cm) + bytes([still_energy]) + w(distance_cm) + bytes([GATES - 1, GATES - 1])
    body += bytes(move) + bytes(still) + bytes([photo, out, 0x55, 0x00])
    return REPORT + w(len(body)) + body + REPORT_END


def command(word: int, data: bytes = b"") -> bytes:
    """A framed command: its word and data, little-endian."""
    body = word.to_bytes(2, "little") + data
    return COMMAND + len(body).to_bytes(2, "little") + body + COMMAND_END


def set_sensitivity(gate: int, move: int, still: int) -> bytes:
    """The command (word 64) that sets one gate's two thresholds, as number and value pairs."""
    pair = lambda k, v: k.to_bytes(2, "little") + v.to_bytes(4, "little")
    return command(0x64, pair(0, gate) + pair(1, move) + pair(2, still))


def command_column(word: int, data: Column) -> Column:
    """command() over a binary column, natively."""
    size = F.hex(F.length(data) + 2)
    low = F.lpad(size, 4, "0")
    little = F.concat(F.substring(low, 3, 2), F.substring(low, 1, 2))
    head = F.concat(F.lit(COMMAND.hex()), little, F.lit(word.to_bytes(2, "little").hex()))
    return F.unhex(F.concat(head, F.hex(data), F.lit(COMMAND_END.hex())))


def decode_stream(chunks: DataFrame) -> DataFrame:
    """(sensor, ts, id, data binary) -> (sensor, ts, id, move, still, distance_cm, device_occ) of every engineering report.

    Pieces of a connection are joined in order; a report carries the time of the piece that completed it.
    """
    schema = "sensor string, ts double, id long, move array<int>, still array<int>, distance_cm int, device_occ boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, cutter, n = None, None, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.sensor != name:
                    name, cutter, n = r.sensor, Cutter(), 0
                for kind, payload in cutter.feed(bytes(r.data)):
                    if kind == "report" and (got := report(payload)):
                        out.append((name, r.ts, n, got["move"], got["still"], got["distance_cm"], got["device_occ"]))
                        n += 1
            yield pd.DataFrame(out, columns=["sensor", "ts", "id", "move", "still", "distance_cm", "device_occ"])

    rows = chunks.select("sensor", "ts", "id", "data").repartition("sensor").sortWithinPartitions("sensor", "ts", "id")
    return rows.mapInPandas(run, schema)

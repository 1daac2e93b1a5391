"""A sensor's learned state as versioned bytes, and the switch of settings without losing it."""

from __future__ import annotations

import io
import pickle
from dataclasses import replace
from functools import lru_cache

import numpy as np

from gatelens.plans.config import Config

from .automaton import Sensor, filters

VERSION = 2


#: Settings of late, by identity, with their bytes.
SETTINGS: dict[int, tuple[Config, bytes]] = {}


def settings_bytes(config: Config) -> bytes:
    held = SETTINGS.get(id(config))
    if held is None:
        if len(SETTINGS) >= 64:
            SETTINGS.clear()
        held = SETTINGS[id(config)] = config, pickle.dumps(config)
    return held[1]


@lru_cache(64)
def settings(data: bytes) -> Config:
    return pickle.loads(data)


def array(data: bytes, kind: str, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(bytearray(data), kind).reshape(shape)


def array_bytes(a: np.ndarray) -> tuple:
    """Small arrays in fewer steps than their own form takes."""
    return array, (a.tobytes(), a.dtype.str, a.shape)


def save(sensor: Sensor) -> bytes:
    """All of the state; settings, which seldom change, are turned into bytes once."""
    out = io.BytesIO()
    pickler = pickle.Pickler(out, pickle.HIGHEST_PROTOCOL)
    pickler.dispatch_table = {Config: lambda c: (settings, (settings_bytes(c),)), np.ndarray: array_bytes}
    pickler.dump({"version": VERSION, "bucket_s": sensor.c.bucket_s, "window_s": sensor.c.baseline_window_s, "sensor": sensor})
    return out.getvalue()


def restore(data: bytes, config: Config) -> Sensor:
    """The saved state under config; a new sensor where version, bucket or window differ."""
    held = pickle.loads(data)
    if held["version"] != VERSION or (held["bucket_s"], held["window_s"]) != (config.bucket_s, config.baseline_window_s):
        return Sensor(config)
    sensor = held["sensor"]
    return sensor if sensor.c is config or sensor.c == config else reconfigured(sensor, config)


def reconfigured(sensor: Sensor, config: Config) -> Sensor:
    """New settings from the next frame on. What is learned stays; a shorter window forgets its oldest buckets."""
    sensor.c, sensor.on, sensor.classes.c, sensor.filters = config, set(config.stages), config, filters(config)
    sensor.anchor.bar = config.anchor_bar if sensor.bar.bar is None else sensor.bar.bar
    sensor.nearest.hold_s = sensor.change.hold_s = config.hold_s
    sensor.nearest.lost = config.release_fraction
    keep = sensor.retention
    keep.on, keep.off, keep.taus = config.retention_on, config.retention_off, (config.tau_fast, config.tau_slow, config.tau_peak)
    arming = sensor.arming
    arming.quiet_s, arming.count, arming.grace_s, arming.most = config.quiet_s, config.cross_n, config.grace_s, config.lead_gate_max
    base = sensor.baseline
    base.c = replace(config)
    base.levels = base.levels[-config.window_buckets :]
    return sensor

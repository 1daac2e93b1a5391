"""gatelens: analytics over multi-channel sensor series and text on PySpark."""

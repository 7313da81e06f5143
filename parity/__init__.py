"""Every operator as a query on the given tables, paired with the SQL it must equal."""

from parity import feeds, learning, publishing, rows, streams, tables, timeseries
from parity.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "feeds", "learning", "publishing", "rows", "streams", "tables", "timeseries"]

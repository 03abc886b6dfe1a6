"""Queries over the test tables, each with its SQL twin where SQL can say it."""

from framelore.plans import browse, data_quality, exchange, lifecycle, shapes, temporal

ALL = [data_quality, browse, shapes, temporal, lifecycle, exchange]

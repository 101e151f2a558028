"""Request streams: training and forecast requests arriving over time.

The service queued one background task per request; here a Structured
Streaming source of request rows drives the batch jobs, one micro-batch at
a time (see ``requests``).  Prices themselves are read as tables: every
feature is a window over a bounded date range, recomputed per batch.
"""

from .requests import forecast_on_requests, train_on_requests

__all__ = ["forecast_on_requests", "train_on_requests"]

"""tidecast: daily time-series features, per-series least squares, a model
registry and recursive business-day forecasts for many series at once, as
Spark DataFrame jobs.

Entry points: ``train_all`` / ``forecast_all`` (lazy plans),
``plans.jobs`` (the same with their sinks), ``sources.read_prices``,
``operators.*`` for the individual steps, ``python -m tidecast`` for the
command line.
"""

from .plans.forecast import forecast_all
from .plans.train import train_all
from .session import build_session
from .sources import read_prices

__version__ = "0.1.0"
__all__ = ["build_session", "forecast_all", "read_prices", "train_all"]

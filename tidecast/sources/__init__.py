"""Sources and sinks: price readers, fixture adapters, the model registry store."""

from .prices import (daily_close, fixture_prices, normalize_prices, prices_from_lineitem, read_prices,
                     write_bucketed_prices, write_yearly_prices)

__all__ = ["daily_close", "fixture_prices", "normalize_prices", "prices_from_lineitem", "read_prices",
           "write_bucketed_prices", "write_yearly_prices"]

from .trade_bars import read_trade_stream, streaming_trade_bars, write_bars

"""ohlcraft: candle-pattern research and corpus preparation on Spark DataFrames."""

"""Part of ohlcraft."""

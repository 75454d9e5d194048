"""Document mining and robust price statistics as DataFrame-to-DataFrame operators."""

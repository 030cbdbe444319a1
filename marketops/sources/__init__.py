"""Reading, writing and describing market-event datasets."""

"""Training-data pipeline operators (tokenising, deduplication, classification,
extraction, packing).  Nothing outside this subpackage imports it."""

"""Training-data operators on text tables: encoding, quality, toxicity, chat
formatting, duplicate passages, licences, near-duplicates, benchmark leaks,
secrets and sharding.  Nothing outside this subpackage imports it."""

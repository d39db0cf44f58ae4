"""Training-data operators: de-duplication, language, decontamination, URL, HTML, WARC, sharding, tokens."""

"""Writers: trace documents, telemetry payloads, folded stacks, summaries."""

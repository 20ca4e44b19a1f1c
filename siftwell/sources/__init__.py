"""Sources and sinks: the generation store, job logs, service payloads, relevance judgements, synthetic vectors."""

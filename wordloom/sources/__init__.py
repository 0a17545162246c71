"""Sources and sinks: CSV datasets, the sentence store, text exports."""

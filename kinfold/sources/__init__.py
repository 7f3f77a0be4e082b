"""Record sources and validated sinks."""

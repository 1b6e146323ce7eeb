"""Table definitions, readers, typed imports and report sinks."""

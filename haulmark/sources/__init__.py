"""Tables, domain views, document formats and sinks."""

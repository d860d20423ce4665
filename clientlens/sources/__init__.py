"""Tables, domain views, fixed dimensions and sinks."""

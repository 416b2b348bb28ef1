"""Table-driven parsers: grammars as text, compiled to state tables that read whole token streams."""

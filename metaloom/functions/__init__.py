"""Column functions: text, dates, uris, metadata scalars and the cleaning DSL."""

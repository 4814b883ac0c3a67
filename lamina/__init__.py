"""lamina: analytics over very large rectangle layouts, as DataFrame and SQL plans."""

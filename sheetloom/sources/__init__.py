"""Ways in and out: grids from tables, documents, rule tables, family stores."""

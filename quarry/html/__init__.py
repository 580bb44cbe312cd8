"""HTML to trees, markdown and product records. Plain Python: it runs inside one Arrow function."""

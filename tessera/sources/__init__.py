"""Sources: base tables, record pages of object interfaces, bulk files."""

"""Declarations, request identity and selections: small records that the driver handles."""

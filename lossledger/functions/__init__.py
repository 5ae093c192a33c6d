"""Part of lossledger."""

"""Feed files in; reports, catalog versions, ledger and audit out."""

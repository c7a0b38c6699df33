"""The incremental forms of insert and roll-up."""

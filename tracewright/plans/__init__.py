"""Session, storage and multi-step plans."""

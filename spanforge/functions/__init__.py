"""Part of the entity-detection library; see the README for its layout."""

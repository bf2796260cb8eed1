"""Writers, and all other effects."""

"""The page operators on streams."""

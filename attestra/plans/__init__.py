"""Views of the star-schema tables as the engine's data model."""

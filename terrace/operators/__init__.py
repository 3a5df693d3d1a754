"""DataFrame -> DataFrame operators, every one keyed by ``fixture_id``."""

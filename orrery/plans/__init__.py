"""The named-entity pipeline and the query catalogue."""

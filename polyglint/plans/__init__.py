"""SQL subset, plan facts and result caching."""

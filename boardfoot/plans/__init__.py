"""Plan-level helpers: tables that cut lineage, checked broadcasts."""

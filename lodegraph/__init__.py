"""lodegraph: structural analysis of file collections and snapshot tables on Spark."""

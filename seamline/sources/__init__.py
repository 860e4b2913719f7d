"""Where text comes from (folder trees, tables) and where the index lives."""

"""Plan helpers: scratch tables in the shared folder, checked broadcasts, table loading."""

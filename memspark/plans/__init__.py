"""Jobs composed of several operators, and the shared folder that cuts their lineage."""

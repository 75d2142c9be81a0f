"""Sources: tables, files, importers, snapshots."""

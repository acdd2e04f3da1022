"""Reading and writing: event files, catalog tables, manifests, seeds, file inventories."""

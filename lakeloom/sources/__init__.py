"""Tables, files and catalogs."""

"""Tables, the catalog and its system relations."""

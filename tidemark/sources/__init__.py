"""Reading files, dictionaries, manifests and nested results."""

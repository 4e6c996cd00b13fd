"""Sources: table adapters, code extraction, manifests, documents."""

"""Reading datasets and metadata, writing layouts, manifests and reports."""

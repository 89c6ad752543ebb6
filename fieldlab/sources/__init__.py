"""Reading and writing: device tables, image folders, manifests, run artifacts."""

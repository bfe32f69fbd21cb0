"""Tables on storage: catalog, manifests, file hashes, publishing."""

"""Sources: git, source trees, rule manifests, documents and event payloads as DataFrames."""

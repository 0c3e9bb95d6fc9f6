"""DataFrame operators on points and lineage graphs."""

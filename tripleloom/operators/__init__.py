"""DataFrame-to-DataFrame operators of relation extraction, one module a family."""

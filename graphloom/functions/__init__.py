"""RDF terms as columns, and expressions over them."""

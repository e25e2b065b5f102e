"""Federation members: sources seen as graphs."""

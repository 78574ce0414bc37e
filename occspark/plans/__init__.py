"""Ready-made queries over the test tables, and the adapter that gives those the occurrence shape."""

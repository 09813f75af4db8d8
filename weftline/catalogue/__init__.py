"""Named queries over the test tables, each beside the SQL that says the same."""

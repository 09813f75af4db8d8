"""Planning helpers shared by operators."""

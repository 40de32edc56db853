"""Column -> Column building blocks.  Nothing here triggers a job or a shuffle."""

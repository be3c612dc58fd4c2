"""Developer-activity analytics and training-data operators as Spark plans."""

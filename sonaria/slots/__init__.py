"""Model slots: vectorised user functions run by Spark jobs."""

"""mockloom: make and judge synthetic tables with Spark."""

"""colstate: declaratively maintained datasets on Spark."""

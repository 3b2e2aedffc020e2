"""pagelake: web-page analytics on PySpark."""

"""Column functions over transcript text; all but `diffs` stay inside the JVM."""

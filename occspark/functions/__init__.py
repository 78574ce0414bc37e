"""Column expressions: Column (or column name) in, Column out; all of them stay in the JVM."""

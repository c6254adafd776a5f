"""Column functions: text, identity keys, and calendar periods. All stay in the JVM."""

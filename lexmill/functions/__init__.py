"""Column functions of the engine; all but the ones in `kernels` stay in the JVM."""

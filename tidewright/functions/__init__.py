"""Column functions: every one a JVM-side expression that stays inside whole-stage code generation or a higher-order function."""

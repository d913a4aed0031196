"""Column builders; everything here compiles into Catalyst expressions."""

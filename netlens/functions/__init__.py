"""Column builders. Everything here is a built-in expression unless its module says so."""

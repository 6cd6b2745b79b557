"""The given test tables in the shapes the library works on."""

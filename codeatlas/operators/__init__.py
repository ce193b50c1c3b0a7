"""Search, hierarchy, sheet, catalog and display operators."""

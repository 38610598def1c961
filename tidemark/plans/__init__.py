"""Plans over tables: derived views, registered queries and their SQL."""

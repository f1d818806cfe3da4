"""Help archives, e-books and scraped page sets as Spark tables: encodings, navigation, content, links, reading state."""

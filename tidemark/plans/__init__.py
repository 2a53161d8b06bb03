"""Plans: the queries over the driver tables. Importing a module registers its queries."""

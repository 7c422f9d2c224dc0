"""Named queries over the code graph.

Fixed values: the texts, their parameters and the names of what they return are what users of the graph rely on. Sorts
have further keys, so that results do not change from run to run.
"""

from __future__ import annotations

TEMPLATES: dict[str, dict] = {}


def _add(key: str, category: str, name: str, query: str, *parameters: str) -> None:
    TEMPLATES[key] = {"name": name, "category": category, "query": " ".join(query.split()), "parameters": list(parameters)}


# Files and the whole graph
_add("all_files", "basic", "Files by size", "MATCH (f:File) RETURN f.name, f.path, f.lines_of_code ORDER BY f.lines_of_code DESC, f.path")
_add("entity_counts", "basic", "Entities by type", "MATCH (n) RETURN labels(n)[0] AS entity_type, COUNT(n) AS count ORDER BY count DESC, entity_type")
_add("relationship_counts", "basic", "Relationships by type", "MATCH ()-[r]->() RETURN type(r) AS relationship_type, COUNT(r) AS count ORDER BY count DESC, relationship_type")
_add("node_count", "basic", "Number of nodes", "MATCH (n) RETURN COUNT(n) AS count")
_add("distinct_types", "basic", "Relationship types in use", "MATCH ()-[r]->() RETURN DISTINCT type(r) AS relationship_type")
_add("complex_files", "basic", "Files that hold most", "MATCH (f:File)-[:CONTAINS]->(entity) RETURN f.name, f.path, COUNT(entity) AS entity_count ORDER BY entity_count DESC, f.path LIMIT 10")
_add("file_by_path", "basic", "Files under a path", "MATCH (f:File) WHERE f.path CONTAINS $part RETURN f.name, f.path ORDER BY f.path", "part")
_add("functions_in_file", "basic", "Functions of a file", "MATCH (f:File)-[:FILE_CONTAINS_FUNCTION]->(func:Function) WHERE f.path = $path RETURN func.name, func.line_start ORDER BY func.line_start", "path")
_add("imports_under_path", "basic", "Imports under a path", "MATCH (f:File)-[:FILE_CONTAINS_IMPORT]->(i:Import) WHERE f.path CONTAINS $part RETURN f.path, i.name, i.module_name ORDER BY f.path, i.name", "part")
_add("functions_per_file", "basic", "Functions of each file", "MATCH (f:File)-[:FILE_CONTAINS_FUNCTION]->(func:Function) RETURN f.path, COUNT(func) AS function_count ORDER BY function_count DESC, f.path")
# Functions
_add("find_callers", "functions", "Callers of a function, one row a call", "MATCH (caller:Function)-[:CALLS]->(target:Function {name: $function_name}) RETURN caller.name, caller.file_path, caller.line_start", "function_name")
_add("find_callers_distinct", "functions", "Distinct callers", "MATCH (caller:Function)-[:CALLS]->(target:Function {name: $function_name}) RETURN DISTINCT caller.name AS caller_name, caller.file_path AS caller_file, caller.line_start AS caller_line ORDER BY caller_file, caller_line", "function_name")
_add("unused_functions", "functions", "Functions that nothing calls", "MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) AND f.name <> '__init__' RETURN f.name, f.file_path, f.line_start ORDER BY f.file_path, f.line_start")
_add("never_called", "functions", "Uncalled, without tests and entry points", "MATCH (f:Function) WHERE NOT ()-[:CALLS]->(f) AND f.name <> '__init__' AND f.name <> '__main__' AND NOT f.name STARTS WITH 'test_' RETURN f.name, f.file_path, f.line_start ORDER BY f.file_path, f.line_start")
_add("unused_but_main", "functions", "Uncalled, without main", "MATCH (f:Function) WHERE NOT exists((:Function)-[:CALLS]->(f)) AND NOT f.name IN ['__init__', 'main'] RETURN f.name, f.file_path ORDER BY f.file_path, f.name")
_add("most_called", "functions", "Most called functions", "MATCH (caller:Function)-[:CALLS]->(target:Function) RETURN target.name AS function_name, target.file_path AS file_path, COUNT(caller) AS call_count ORDER BY call_count DESC, file_path, function_name LIMIT 20")
_add("heavily_called", "functions", "Most called names", "MATCH (:Function)-[c:CALLS]->(f:Function) RETURN f.name, COUNT(c) AS call_count ORDER BY call_count DESC, f.name LIMIT 20")
_add("high_complexity", "functions", "Complex functions", "MATCH (f:Function) WHERE f.complexity > $min_complexity RETURN f.name, f.file_path, f.complexity, f.line_start ORDER BY f.complexity DESC, f.file_path, f.line_start", "min_complexity")
_add("count_complex", "functions", "Number of complex functions", "MATCH (f:Function) WHERE f.complexity > $min_complexity RETURN COUNT(f) AS count", "min_complexity")
_add("recursive_functions", "functions", "Functions that call themselves", "MATCH (f:Function)-[:CALLS]->(f) RETURN f.name, f.file_path, f.line_start ORDER BY f.file_path, f.line_start")
_add("long_functions", "functions", "Long functions", "MATCH (f:Function) WHERE (f.line_end - f.line_start) > $min_lines RETURN f.name, f.file_path, (f.line_end - f.line_start + 1) AS line_count ORDER BY line_count DESC, f.file_path, f.name", "min_lines")
_add("calls_something", "functions", "Functions that call", "MATCH (f:Function) WHERE exists((f)-[:CALLS]->()) RETURN f.name, f.file_path ORDER BY f.file_path, f.name")
_add("calls_per_function", "functions", "Calls of each function", "MATCH (f:Function) OPTIONAL MATCH (f)-[:CALLS]->(called:Function) RETURN f.name, f.file_path, COUNT(called) AS calls_made ORDER BY calls_made DESC, f.file_path, f.name")
# Classes
_add("inheritance_hierarchy", "classes", "Inheritance paths to a class", "MATCH path = (child:Class)-[:INHERITS*]->(parent:Class {name: $class_name}) RETURN path", "class_name")
_add("find_subclasses", "classes", "All subclasses", "MATCH (parent:Class {name: $class_name})<-[:INHERITS*]-(child:Class) RETURN DISTINCT child.name AS subclass_name, child.file_path ORDER BY subclass_name, child.file_path", "class_name")
_add("leaf_classes", "classes", "Classes without subclasses", "MATCH (c:Class) WHERE NOT (c)<-[:INHERITS]-() RETURN c.name, c.file_path ORDER BY c.name, c.file_path")
_add("classes_many_methods", "classes", "Classes with most functions", "MATCH (c:Class)-[:CONTAINS]->(m:Function) RETURN c.name AS class_name, c.file_path, COUNT(m) AS method_count ORDER BY method_count DESC, c.file_path, class_name LIMIT 10")
_add("abstract_classes", "classes", "Abstract classes", "MATCH (c:Class) WHERE c.is_abstract = true RETURN c.name, c.file_path, c.docstring ORDER BY c.name, c.file_path")
_add("large_classes", "classes", "Long classes", "MATCH (c:Class) WHERE (c.line_end - c.line_start) > $min_lines RETURN c.name, c.file_path, (c.line_end - c.line_start + 1) AS line_count ORDER BY line_count DESC, c.name", "min_lines")
_add("class_usage", "classes", "Users of a class", "MATCH (target:Class {name: $class_name})<-[:USES]-(user) RETURN DISTINCT user.name AS user_name, labels(user)[0] AS user_type, user.file_path AS file_path ORDER BY file_path, user_name", "class_name")
# Dependencies
_add("file_dependencies", "dependencies", "Files that a file imports", "MATCH (source:File {name: $file_name})-[:CONTAINS]->(:Import)-[:IMPORTS]->(target:File) RETURN DISTINCT target.name AS dependency, target.path ORDER BY dependency, target.path", "file_name")
_add("dependent_files", "dependencies", "Files that import a file", "MATCH (dependent:File)-[:CONTAINS]->(:Import)-[:IMPORTS]->(target:File {name: $file_name}) RETURN DISTINCT dependent.name AS dependent_file, dependent.path ORDER BY dependent_file, dependent.path", "file_name")
_add("imported_files", "dependencies", "Files that a file imports, by its path", "MATCH (f:File)-[:IMPORTS]->(imported:File) WHERE f.path = $path RETURN DISTINCT imported.path ORDER BY imported.path", "path")
_add("circular_dependencies", "dependencies", "Circular imports", "MATCH path = (f1:File)-[:IMPORTS*2..10]->(f1) WHERE length(path) > 2 RETURN path LIMIT 10")
_add("mutual", "dependencies", "Files that import each other", "MATCH (a:File)-[:IMPORTS]->(b:File) WHERE a.path < b.path AND exists((b)-[:IMPORTS]->(a)) RETURN DISTINCT a.path AS one, b.path AS two ORDER BY one, two")
_add("most_imported", "dependencies", "Most imported modules", "MATCH (file:File)-[:CONTAINS]->(import:Import) RETURN import.module_name AS module, COUNT(DISTINCT file) AS import_count ORDER BY import_count DESC, module LIMIT 20")
_add("external_dependencies", "dependencies", "Modules that no file of the tree is", "MATCH (import:Import) WHERE NOT EXISTS((import)-[:IMPORTS]->(:File)) RETURN DISTINCT import.module_name AS external_module, COUNT(*) AS usage_count ORDER BY usage_count DESC, external_module")
_add("function_impact", "dependencies", "What a change may touch", "MATCH path = (target:Function {name: $function_name})<-[:CALLS*1..3]-(affected) RETURN DISTINCT affected.name AS affected_entity, labels(affected)[0] AS entity_type, affected.file_path AS file_path, length(path) AS distance ORDER BY distance, file_path, affected_entity", "function_name")
_add("dependency_chain", "dependencies", "Calls from one function to another", "MATCH path = (start:Function {name: $start_function})-[:CALLS*1..5]->(end:Function {name: $end_function}) RETURN path ORDER BY length(path) LIMIT 5", "start_function", "end_function")
_add("reachable_from_entry", "dependencies", "Reachable from an entry point", "MATCH path = (entry:Function {name: $entry_point})-[:CALLS*]->(reachable:Function) RETURN DISTINCT reachable.name AS reachable_function, reachable.file_path AS file_path, MIN(length(path)) AS min_distance ORDER BY min_distance, file_path, reachable_function", "entry_point")
# Quality
_add("missing_docstrings", "quality", "Functions without a docstring", "MATCH (f:Function) WHERE (f.docstring IS NULL OR f.docstring = '') AND NOT f.name STARTS WITH '_' RETURN f.name, f.file_path, f.line_start ORDER BY f.file_path, f.line_start")
_add("many_parameters", "quality", "Functions with many parameters", "MATCH (f:Function) WHERE f.signature CONTAINS ',' WITH f, size(split(f.signature, ',')) AS param_count WHERE param_count > $max_params RETURN f.name, f.file_path, f.signature, param_count ORDER BY param_count DESC, f.file_path, f.name", "max_params")
_add("duplicate_names", "quality", "Names defined in several files", "MATCH (f1:Function), (f2:Function) WHERE f1.name = f2.name AND f1.file_path <> f2.file_path RETURN f1.name AS function_name, COLLECT(DISTINCT f1.file_path) AS files ORDER BY function_name")
_add("most_connected", "quality", "Most connected functions", "MATCH (f:Function) WITH f, count{(f)-[:CALLS]->()} AS made, count{()-[:CALLS]->(f)} AS had RETURN f.name, f.file_path, made + had AS connections ORDER BY connections DESC, f.file_path, f.name LIMIT 10")
# Reports
_add("analyze_function", "reports", "A function with callers and callees", """MATCH (f:Function {name: $function_name}) OPTIONAL MATCH (f)<-[:CALLS]-(caller:Function) OPTIONAL MATCH (f)-[:CALLS]->(called:Function)
  OPTIONAL MATCH (f)<-[:CONTAINS]-(containing_class:Class) RETURN f AS function_details, COLLECT(DISTINCT caller.name) AS callers, COLLECT(DISTINCT called.name) AS calls, containing_class.name AS class_name""", "function_name")
_add("analyze_class", "reports", "A class with parents, children and functions", """MATCH (c:Class {name: $class_name}) OPTIONAL MATCH (c)-[:CONTAINS]->(method:Function) OPTIONAL MATCH (c)-[:INHERITS]->(parent:Class)
  OPTIONAL MATCH (child:Class)-[:INHERITS]->(c) RETURN c AS class_details, COLLECT(DISTINCT method.name) AS methods, parent.name AS parent_class, COLLECT(DISTINCT child.name) AS child_classes""", "class_name")
_add("analyze_file", "reports", "A file with its parts and imports", """MATCH (f:File {name: $file_name}) OPTIONAL MATCH (f)-[:CONTAINS]->(entity) OPTIONAL MATCH (f)-[:CONTAINS]->(:Import)-[:IMPORTS]->(dep:File)
  RETURN f AS file_details, COLLECT(DISTINCT labels(entity)[0]) AS entity_types, COLLECT(DISTINCT dep.name) AS dependencies""", "file_name")

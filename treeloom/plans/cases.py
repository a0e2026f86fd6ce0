"""Programs of the query language with inputs and outputs, from its public manual's semantics."""

from __future__ import annotations

CASES: list[tuple[str, str, list[str]]] = [
    ('.a.b', '{"a":{"b":1}}', ['1']),
    ('[.[]|.*2]', '[1,2]', ['[2,4]']),
    ('map(select(.>1))', '[1,2,3]', ['[2,3]']),
    ('.[1:]', '[1,2,3]', ['[2,3]']),
    ('.[-1]', '[1,2]', ['2']),
    ('try error("x") catch .', 'null', ['"x"']),
    ('.a//"d"', '{"a":false}', ['"d"']),
    ('[.[]|if .>1 then "b" elif .==1 then "o" else "s" end]', '[0,1,2]', ['["s","o","b"]']),
    ('reduce .[] as $x (0;.+$x)', '[1,2,3]', ['6']),
    ('[foreach .[] as $x (0;.+$x;[$x,.])]', '[1,2]', ['[[1,1],[2,3]]']),
    ('"a\\(1+2)b"', 'null', ['"a3b"']),
    ('[paths]', '{"a":[1]}', ['[["a"],["a",0]]']),
    ('.a|=.+1', '{"a":1}', ['{"a":2}']),
    ('.[]+=1', '[1,2]', ['[2,3]']),
    ('.a.b.c=1', 'null', ['{"a":{"b":{"c":1}}}']),
    ('del(.[0,2])', '[1,2,3]', ['[2]']),
    ('to_entries', '{"b":1}', ['[{"key":"b","value":1}]']),
    ('with_entries(.value+=1)', '{"a":1}', ['{"a":2}']),
    ('group_by(.a)', '[{"a":2},{"a":1},{"a":2}]', ['[[{"a":1}],[{"a":2},{"a":2}]]']),
    ('[limit(2;range(10))]', 'null', ['[0,1]']),
    ('first(range(5;10))', 'null', ['5']),
    ('[.[]|tostring]', '[1,"a",[1]]', ['["1","a","[1]"]']),
    ('[match("a(?<x>b)?";"g")|.captures[0].string]', '"ab a"', ['["b",null]']),
    ('capture("(?<y>\\\\d+)")', '"a12"', ['{"y":"12"}']),
    ('gsub("a";"b")', '"aXa"', ['"bXb"']),
    ('[scan("\\\\d")]', '"a1b2"', ['["1","2"]']),
    ('sub("(?<x>a)";"\\(.x)!")', '"cab"', ['"ca!b"']),
    ('walk(if type=="number" then .+1 else . end)', '[1,{"a":2}]', ['[2,{"a":3}]']),
    ('[..]', '[1,[2]]', ['[[1,[2]],1,[2],2]']),
    ('def f(g): [g,g]; f(.a)', '{"a":1}', ['[1,1]']),
    ('def fac: if .<=1 then 1 else .*(.-1|fac) end; fac', '5', ['120']),
    ('. as [$a,{b:$c}] | $a+$c', '[1,{"b":2}]', ['3']),
    ('label $f | .[] | if .>1 then break $f else . end', '[1,2,3]', ['1']),
    ('@base64', '"hi"', ['"aGk="']),
    ('@csv', '[1,"a\\"b",null]', ['"1,\\"a\\"\\"b\\","']),
    ('@uri', '"a b/é"', ['"a%20b%2F%C3%A9"']),
    ('@html "x\\(.)"', '"<"', ['"x&lt;"']),
    ('tojson', '{"a":1.5}', ['"{\\"a\\":1.5}"']),
    ('[splits(", *")]', '"a, b"', ['["a","b"]']),
    ('ascii_downcase', '"AbÉ"', ['"abÉ"']),
    ('[.[]|floor]', '[1.5,-1.5]', ['[1,-2]']),
    ('min_by(.a),max_by(.a)', '[{"a":1,"b":1},{"a":1,"b":2}]', ['{"a":1,"b":1}', '{"a":1,"b":2}']),
    ('unique', '[2,1,2]', ['[1,2]']),
    ('any,all', '[true,false]', ['true', 'false']),
    ('flatten(1)', '[1,[2,[3]]]', ['[1,2,[3]]']),
    ('[range(0;10;3)]', 'null', ['[0,3,6,9]']),
    ('{a:1,"b":2,(.k):3,$__loc__}|del(.__loc__)', '{"k":"c"}', ['{"a":1,"b":2,"c":3}']),
    ('{a,b}', '{"a":1,"b":2,"c":3}', ['{"a":1,"b":2}']),
    ('[tostream]', '{"a":[1]}', ['[[["a",0],1],[["a",0]],[["a"]]]']),
    ('fromstream(tostream)', '{"a":[1,{"b":2}]}', ['{"a":[1,{"b":2}]}']),
    ('strftime("%Y-%m-%d")', '0', ['"1970-01-01"']),
    ('fromdate', '"2015-03-05T23:51:47Z"', ['1425599507']),
    ('[.[]|until(.>100;.*2)]', '[1]', ['[128]']),
    ('[recurse(if .<3 then .+1 else empty end)]', '1', ['[1,2,3]']),
    ('input_line_number', 'null', ['0']),
    ('.a,.b|.c', '{"a":{"c":1},"b":{"c":2}}', ['1', '2']),
    ('[.[]|(1,2)*.]', '[10]', ['[10,20]']),
    ('. as {a:$x} ?// [$x] | $x', '[3]', ['3']),
    ('[env|type]', 'null', ['["object"]']),
    ('.. |= (if type=="number" then .+1 else . end)', '[1,[2]]', ['[2,[3]]']),
    ('map_values(empty)', '{"a":1}', ['{}']),
    ('(.a,.b)=9', '{"a":1}', ['{"a":9,"b":9}']),
    ('.[2:4]=["x"]', '[1,2,3,4,5]', ['[1,2,"x",5]']),
    ('to_entries|map("\\(.key)=\\(.value)")|join("&")', '{"a":1,"b":2}', ['"a=1&b=2"']),
    ('splits("a";null)', '"bab"', ['"b"', '"b"']),
    ('[.[]|ltrimstr("x")]', '["xa","b",1]', ['["a","b",1]']),
    ('pick(.a.b)', '{"a":{"b":1,"c":2}}', ['{"a":{"b":1}}']),
    ('transpose', '[[1],[2,3]]', ['[[1,2],[null,3]]']),
    ('[combinations]', '[[1,2],[3]]', ['[[1,3],[2,3]]']),
    ('IN(1,2)', '2', ['true']),
    ('INDEX(.a)', '[{"a":1}]', ['{"1":{"a":1}}']),
    ('getpath(["a","b"])', '{"a":null}', ['null']),
    ('1 as $x | [$x,2 as $y|$x+$y]', 'null', ['[1,3]']),
    ('[.[] as $x | $x*2]', '[1,2]', ['[2,4]']),
    ('.a as $x | .b | .+$x', '{"a":1,"b":2}', ['3']),
    ('100000000000000000000', 'null', ['100000000000000000000']),
    ('-(1)', 'null', ['-1']),
    ('[.[]|-.]', '[1]', ['[-1]']),
    ('if . then 1 end', 'false', ['false']),
    ('[skip(1;.[])]', '[1,2,3]', ['[2,3]']),
    ('try (1/0) catch "z"', '1', ['"z"']),
    ('.a["b"].c[0]', '{"a":{"b":{"c":[5]}}}', ['5']),
    ('."x y"', '{"x y":1}', ['1']),
    ('.a."b"', '{"a":{"b":1}}', ['1']),
    ('[.[]?]', '1', ['[]']),
    ('reduce range(3) as $i ([]; . + [$i])', 'null', ['[0,1,2]']),
    ('limit(1; .[] | select(.>1))', '[1,2,3]', ['2']),
    ('add(.[].a)', '[{"a":1},{"a":2}]', ['3']),
    ('has("a"), has("b")', '{"a":1}', ['true', 'false']),
    ('ascii', '65', ['"A"']),
    ('implode', '[128512]', ['"😀"']),
    ('@sh', '["a\'b",1]', ['"\'a\'\\\\\'\'b\' 1"']),
    ('def f($a; g): $a+g; f(1;2)', 'null', ['3']),
    ('def f: def g: 3; g; f', 'null', ['3']),
    ('[.[]|try tonumber catch "bad"]', '["1","x"]', ['[1,"bad"]']),
]
CASES += [
    (".a", "null", ["null"]), (".a?", "1", []), (".[1.7]", "[1,2]", ["2"]), (".[1e300]", "[1]", ["null"]), (".a += 1", "{}", ['{"a":1}']), (".a //= 3", '{"a":false}', ['{"a":3}']), (".[-1] = 9", "[1,2]", ["[1,9]"]), ("del(.a, .b)", '{"a":1,"b":2,"c":3}', ['{"c":3}']),
    ("delpaths([[0],[1]])", "[1,2,3]", ["[3]"]), ("to_entries[0].key", '{"z":1,"a":2}', ['"z"']), ("keys, keys_unsorted", '{"z":1,"a":2}', ['["a","z"]', '["z","a"]']), ("[.[] | not]", "[1,null,false]", ["[false,true,true]"]), ("[1,2] - [2]", "null", ["[1]"]),
    ("sort", '[{"a":1},[1],"x",2,true,false,null]', ['[null,false,true,2,"x",[1],{"a":1}]']), ("nan < 1, nan == nan", "null", ["true", "false"]), ("0.1 + 0.2 == 0.3", "null", ["false"]), ("9007199254740993", "null", ["9007199254740993"]), ("try error catch .", '"x"', ['"x"']), ("isvalid", "1", ["true"]), ("{(.a, .b): 1}", '{"a":"x","b":"y"}', ['{"x":1}', '{"y":1}']),
    ("ltrimstr(1)", '"a"', ['"a"']), ('test("A"; "i")', '"xa"', ["true"]), ("[limit(0; 1, 2)]", "null", ["[]"]), ("tojson | fromjson", '{"a":[1.50]}', ['{"a":[1.5]}']), (". as [$a, [$b]] | $b", "[1,[2]]", ["2"]), ("[.[] | select(type == \"number\")]", '[1,"a"]', ["[1]"]), ('reduce empty as $x (0; 1)', "null", ["0"]), ("[paths(type == \"number\")]", '{"a":[1,"b"]}', ['[["a",0]]']),
]
CASES += [
    ("[.[-1.5], .[-0.5], .[nan]]", "[1,2]", ["[2,1,null]"]), ("[has(-1), has(-0.5), has(1.5), has(nan)]", "[1]", ["[false,true,false,false]"]), ("has(1)", "null", ["false"]), ("[.[0, 1][0, 1]]", "[[5,6],[7,8]]", ["[5,7,6,8]"]),
    (".q[2] = 7", "{}", ['{"q":[null,null,7]}']), (".q.r = .q", "{}", ['{"q":{"r":null}}']), ("del(.[0], .[2])", "[4,5,6]", ["[5]"]), ("del(.[-7])", "[4]", ["[4]"]), ("delpaths([[]])", "3", ["null"]), ("pick(.[2])", "null", ["[null,null,null]"]), ("del(.[] | select(. > 4))", "[3,5,6,2]", ["[3,2]"]),
]

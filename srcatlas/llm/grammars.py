"""Bundled grammars of the languages that are judged, one EBNF text each, for the recogniser in glr.py.

Tokens: 'a' name, '0' number, '"' string or character, others as written. Precedence does not matter for recognition.
"""

from __future__ import annotations

JSON = r"""
program: value
value: '{' '}' | '{' pair % ',' '}' | '[' ']' | '[' value % ',' ']' | '"' | '0' | 'true' | 'false' | 'null'
pair: '"' ':' value
"""

TOML = r"""
program: line+
line: 'nl' | key '=' value 'nl' | '[' key ']' 'nl' | '[' '[' key ']' ']' 'nl'
key: part % '.'
part: 'a' | '0' | '"'
value: 'a' | '0' | '"' | '[' gap ']' | '[' gap? items gap? ']' | '{' '}' | '{' (key '=' value) % ',' '}'
items: value | items gap? ',' gap? value | items gap? ','
gap: 'nl'+
"""

YAML = r"""
program: doc | 'nl'+
doc: node | '---' 'nl' node? | doc '---' 'nl' node? | doc '...' 'nl'
node: map | seq | flow 'nl' | text | prop+ 'nl' (map | seq) | prop+ flow 'nl'
text: scalar 'nl' | text scalar 'nl' | text 'in' scalar 'nl' 'out'
scalar: 'a' | '0'
map: entry+
entry: key ':' 'nl' | key ':' inline | key ':' prop* 'nl' 'in' node 'out' | key ':' prop* 'nl' seq | '?' inline ':' inline
key: 'a' | '0' | '"' | '<<' | flowlist | flowmap
inline: prop* flow 'nl' | prop+ 'nl' | prop* scalar 'nl' 'in' more 'out' | prop* '|' 'nl' | 'alias' 'nl'
more: (scalar 'nl')+
prop: 'anchor' | 'tag'
seq: item+
item: '-' 'nl' | '-' inline | '-' 'nl' 'in' node 'out' | '-' entry | '-' entry 'in' map 'out' | '-' 'in' map 'out' | '-' item | '-' 'in' seq 'out'
flow: 'a' | '0' | '"' | flowlist | flowmap
flowlist: '[' ']' | '[' fitem % ',' ','? ']'
flowmap: '{' '}' | '{' fpair % ',' ','? '}'
fitem: flow | flow ':' flow | 'alias'
fpair: flow ':' flow | flow ':' | flow | flow ':' 'alias'
"""

_JS_COMMON = r"""
program: item+
item: stmt | imp | exp
id: 'a' | 'from' | 'of' | 'as' | 'async' | 'get' | 'set' | 'static' | 'type' | 'let_'
imp: 'import' '"' ';' | 'import' impc 'from' '"' ';'
impc: id | id ',' impn | impn
impn: '*' 'as' id | '{' '}' | '{' ispec % ',' ','? '}'
ispec: pname | pname 'as' pname
exp: 'export' decl | 'export' 'default' (func | cls | expr ';') | 'export' '*' 'from' '"' ';' | 'export' '*' 'as' id 'from' '"' ';' | 'export' impn 'from' '"' ';' | 'export' impn ';'
vars: varkind binding % ','
varkind: 'var' | 'let' | 'const'
stmt: block | decl | ';' | expr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | loop | 'return' expr? ';' | 'throw' expr ';'
  | 'try' block 'finally' block | 'try' block catch ('finally' block)? | 'switch' '(' expr ')' '{' case* '}' | 'break' id? ';' | 'continue' id? ';' | id ':' stmt | 'debugger' ';'
loop: 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forinit? ';' expr? ';' expr? ')' stmt | 'for' 'await'? '(' (varkind target | lhs) ('of' | 'in') expr ')' stmt
forinit: vars | expr
catch: 'catch' block | 'catch' '(' binding ')' block
case: 'case' expr ':' stmt* | 'default' ':' stmt*
block: '{' stmt* '}'
target: id | obj | arr
func: 'async'? 'function' '*'? id? sig block
method: @name@ sig block
expr: assign % ','
assign: cond | unary asg assign | arrow | 'yield' assign? | 'yield' '*' assign
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>=_' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
arrow: 'async'? (id | sig) '=>' (block | assign)
cond: bin | bin '?' assign ':' assign
bin: unary | bin bop unary
bop: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof'
unary: post | uop unary
uop: '!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await'
arr: '[' ','* ']' | '[' ','* ael (','+ ael)* ','* ']'
ael: assign | '...' assign
obj: '{' '}' | '{' prop % ',' ','? '}'
prop: pname ':' assign | id | id '=' assign | pmod* method | '...' assign
pmod: 'async' | 'get' | 'set' | '*'
pname: id | '"' | '0' | '[' assign ']' | 'default' | 'delete' | 'new' | 'in' | 'if' | 'for' | 'import' | 'class' | 'return' | 'function' | 'catch' | 'finally' | 'typeof' | 'export' | 'const' | 'var' | 'let' | '#a'
args: '(' ')' | '(' ael % ',' ','? ')'
"""

JS = _JS_COMMON.replace("@name@", "pname") + r"""
decl: func | cls | vars ';'
binding: target ('=' assign)?
param: target ('=' assign)? | '...' target
sig: '(' ')' | '(' param % ',' ','? ')'
cls: 'class' id? ('extends' lhs)? '{' member* '}'
member: ';' | mmod* method | 'static'* pname ('=' assign)? ';' | 'static' block
mmod: pmod | 'static'
post: lhs ('++' | '--')?
lhs: prim | lhs '.' pname | lhs '?.' pname | lhs '?.' args | lhs '?.' '[' expr ']' | lhs '[' expr ']' | lhs args | lhs '"' | 'new' lhs | 'import' args
prim: id | '0' | '"' | arr | obj | '(' expr ')' | func | cls
"""

TS = _JS_COMMON.replace("@name@", "pname '?'?") + r"""
decl: func | fsig | cls | vars ';' | 'declare' decl | 'interface' id tparams? ('extends' tref % ',')? tbody | 'type' id tparams? '=' type ';' | 'const'? 'enum' id '{' (enumm % ',' ','?)? '}' | ('namespace' | 'module') qual '{' item* '}' | 'abstract' cls
fsig: 'async'? 'function' id sig ';'
enumm: pname ('=' assign)?
binding: target '!'? (':' type)? ('=' assign)?
param: pacc* target '?'? (':' type)? ('=' assign)? | '...' target (':' type)?
pacc: 'public' | 'private' | 'protected' | 'readonly' | 'override' | deco
deco: '@' lhs
sig: tparams? '(' ')' (':' rtype)? | tparams? '(' param % ',' ','? ')' (':' rtype)?
rtype: type | id 'is' type | 'asserts' id
cls: deco* 'class' id? tparams? ('extends' lhs targs?)? ('implements' tref % ',')? '{' member* '}'
member: ';' | mmod* method | mmod* pname '?'? sig ';' | mmod* pname ('?' | '!')? (':' type)? ('=' assign)? ';' | 'static' block | index ';'
mmod: pmod | 'static' | pacc | 'abstract' | 'declare'
index: '[' id ':' type ']' ':' type
tbody: '{' '}' | '{' tmem (tsep tmem)* tsep? '}'
tsep: ';' | ','
tmem: 'readonly'? pname '?'? ':' type | pname '?'? sig | index | sig | 'new' sig
type: utype | sigtype | utype 'extends' utype '?' type ':' type | 'new' sigtype
sigtype: tparams? '(' ')' '=>' rtype | tparams? '(' param % ',' ','? ')' '=>' rtype
utype: '|'? itype ('|' itype)*
itype: ptype ('&' ptype)*
ptype: tprim | ptype '[' ']' | ptype '[' type ']' | 'keyof' ptype | 'typeof' qual | 'readonly' ptype | 'infer' id
tprim: tref | '"' | '0' | '-' '0' | tbody | '{' '[' id 'in' type ']' '?'? ':' type ';'? '}' | '[' ']' | '[' telem % ',' ','? ']' | '(' type ')' | 'void'
telem: type '?'? | '...' type | id '?'? ':' type
tref: qual targs?
qual: id | qual '.' id
targs: '<' type % ',' '>'
tparams: '<' tparam % ',' ','? '>'
tparam: id ('extends' type)? ('=' type)?
post: lhs ('++' | '--' | '!')? | post 'as' type | post 'satisfies' type
lhs: prim | lhs '.' pname | lhs '?.' pname | lhs '?.' args | lhs '?.' '[' expr ']' | lhs '[' expr ']' | lhs targs? args | lhs '"' | lhs '!' | 'new' lhs targs? args | 'new' lhs | 'import' args
prim: id | '0' | '"' | arr | obj | '(' expr ')' | func | cls | '<' type '>' unary
"""

PYTHON = r"""
program: stmt+
stmt: simple | compound
simple: small % ';' ';'? 'nl'
small: exprs | exprs (asg rhs)+ | exprs augasg rhs | exprs ':' test ('=' rhs)? | 'del' exprs | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (test ('from' test)?)? | 'import' asname % ',' | 'from' dots 'import' names
  | ('global' | 'nonlocal') id % ',' | 'assert' test (',' test)? | 'yield' | 'type' id '=' test
id: 'a' | 'match' | 'case' | 'type'
asg: '='
augasg: '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**='
rhs: exprs | yieldx
yieldx: 'yield' exprs? | 'yield' 'from' test
dots: dotted | dot+ dotted?
dot: '.' | '...'
dotted: id % '.'
asname: dotted ('as' id)?
names: '*' | iname % ',' | '(' iname % ',' ','? ')'
iname: id ('as' id)?
compound: ifx | 'while' named ':' suite ('else' ':' suite)? | forx | 'try' ':' suite handlers | withx | deco* 'async'? 'def' id tp? '(' params? ')' ('->' test)? ':' suite | deco* 'class' id tp? ('(' args? ')')? ':' suite | 'match' exprs ':' 'nl' 'in_' casex+ 'out_'
tp: '[' (id (':' test)?) % ',' ']'
ifx: 'if' named ':' suite elifx* ('else' ':' suite)?
elifx: 'elif' named ':' suite
forx: 'async'? 'for' stars 'in' exprs ':' suite ('else' ':' suite)?
stars: star % ',' ','?
handlers: 'finally' ':' suite | handler+ ('else' ':' suite)? ('finally' ':' suite)?
handler: 'except' '*'? (exprs ('as' id)?)? ':' suite
withx: 'async'? 'with' withitem % ',' ':' suite | 'async'? 'with' '(' withitem % ',' ','? ')' ':' suite
withitem: test ('as' post)?
casex: 'case' pats ('if' named)? ':' suite
pats: pat % ',' ','?
pat: named ('as' id)? | '*' id
deco: '@' named 'nl'
suite: simple | 'nl' 'in_' stmt+ 'out_'
params: param % ',' ','?
param: id (':' test)? ('=' test)? | '*' id (':' star)? | '*' | '**' id (':' test)? | '/'
named: test | id ':=' test
exprs: star % ',' ','?
star: named | '*' bin
test: bin | bin 'if' bin 'else' test | lambda
lambda: 'lambda' lparams? ':' test
lparams: lparam % ',' ','?
lparam: id ('=' test)? | '*' id | '*' | '**' id | '/'
bin: unary | bin bop unary
bop: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' | '<' | '>' | '<=' | '>=' | '==' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | 'and' | 'or'
unary: post | uop unary
uop: '-' | '+' | '~' | 'not' | 'await'
post: atom | post '.' id | post '(' ')' | post '(' args ')' | post '[' subs ']'
args: arg % ',' ','?
arg: named | id '=' test | '*' test | '**' test | named comp
subs: sub % ',' ','?
sub: named | '*' bin | test? ':' test? | test? ':' test? ':' test?
comp: compfor+
compfor: 'async'? 'for' stars 'in' bin compif* | 'async'? 'for' stars 'in' bin 'if' bin 'else' test compif* | 'async'? 'for' stars 'in' lambda
compif: 'if' bin | 'if' lambda | 'if' id ':=' bin
atom: id | '0' | str | '...' | '(' ')' | '(' exprs ')' | '(' yieldx ')' | '(' named comp ')' | '[' ']' | '[' exprs ']' | '[' named comp ']' | '{' '}' | '{' pair % ',' ','? '}' | '{' exprs '}' | '{' test ':' test comp '}' | '{' named comp '}'
pair: test ':' test | '**' bin
str: '"'+
"""

JAVA = r"""
program: pkg? top*  | pkg
pkg: anno* 'package' qual ';'
top: 'import' 'static'? qual ('.' '*')? ';' | tdecl | ';'
qual: id | qual '.' id
id: 'a' | 'record' | 'var' | 'yield' | 'sealed' | 'permits'
anno: '@' qual | '@' qual '(' ')' | '@' qual '(' annoarg % ',' ')'
annoarg: id '=' annoval | annoval
annoval: cond | anno | '{' '}' | '{' annoval % ',' ','? '}'
mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | anno
tdecl: mod* 'class' id tparams? ('extends' type)? ('implements' type % ',')? ('permits' type % ',')? body | mod* 'interface' id tparams? ('extends' type % ',')? body
  | mod* 'enum' id ('implements' type % ',')? '{' enums? (';' member*)? '}' | mod* '@' 'interface' id body | mod* 'record' id tparams? '(' params? ')' ('implements' type % ',')? body
enums: enumc % ',' ','?
enumc: anno* id args? body?
body: '{' member* '}'
member: ';' | tdecl | 'static'? block | mod* tparams? (type | 'void') id '(' params? ')' dims? throws? (block | ';') | mod* tparams? id '(' params? ')' throws? block | mod* type vdecl % ',' ';' | mod* type id '(' ')' 'default' annoval ';' | mod* id block
throws: 'throws' type % ','
dims: ('[' ']')+
params: param % ','
param: mod* type '...'? id dims?
vdecl: id dims? ('=' init)?
init: expr | arrinit
arrinit: '{' '}' | '{' init % ',' ','? '}'
type: (prim | cref) dims?
prim: 'int' | 'long' | 'short' | 'byte' | 'char' | 'boolean' | 'float' | 'double'
cref: id targs? | cref '.' id targs?
targs: '<' '>' | '<' targ % ',' '>'
targ: type | '?' | '?' ('extends' | 'super') type
tparams: '<' tparam % ',' '>'
tparam: id ('extends' type ('&' type)*)?
block: '{' bstmt* '}'
bstmt: stmt | mod* type vdecl % ',' ';' | tdecl
stmt: block | ';' | expr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' finit? ';' expr? ';' (expr % ',')? ')' stmt
  | 'for' '(' mod* type id ':' expr ')' stmt | 'return' expr? ';' | 'throw' expr ';' | 'break' id? ';' | 'continue' id? ';' | 'try' block ('finally' block | catch+ ('finally' block)?) | 'try' '(' res % ';' ';'? ')' block catch* ('finally' block)?
  | switch | 'synchronized' '(' expr ')' block | id ':' stmt | 'assert' expr (':' expr)? ';' | 'yield' expr ';'
finit: mod* type vdecl % ',' | expr % ','
res: mod* type id '=' expr | expr
catch: 'catch' '(' mod* (type ('|' type)*) id ')' block
switch: 'switch' '(' expr ')' '{' case* '}'
case: label ':' bstmt* | label '->' (expr ';' | block | 'throw' expr ';')
label: 'case' cond % ',' | 'default' | 'case' type id
expr: cond | unary asg expr | lambda
lambda: (id | '(' ')' | '(' (id % ',' | params) ')') '->' (block | expr)
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>='
cond: bin | bin '?' expr ':' expr
bin: unary | bin bop unary | bin 'instanceof' 'final'? type id?
bop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||'
unary: post | ('!' | '~' | '+' | '-' | '++' | '--') unary | '(' type ('&' type)* ')' (unary | lambda)
post: primary ('++' | '--')?
primary: id | '0' | '"' | '(' expr ')' | primary '.' id | primary '.' targs id args | id args | primary '.' id args | primary '[' expr ']' | 'new' anno* cref args body? | primary '.' 'new' id args body? | 'new' (prim | cref) ('[' expr ']')+ dims? | 'new' (prim | cref) dims arrinit
  | primary '.' 'class' | (prim | cref) dims? '.' 'class' | 'void' '.' 'class' | (primary | type) '::' (id | 'new') | switch | 'this' | 'super' | 'this' args | 'super' args | primary '.' ('this' | 'super')
args: '(' ')' | '(' expr % ',' ')'
"""

GO = r"""
program: 'package' id ';' imp* top* | 'package' id
imp: 'import' ispec ';' | 'import' '(' ')' ';' | 'import' '(' ispec % ';' ';'? ')' ';'
ispec: '"' | id '"' | '.' '"'
id: 'a'
top: decl ';' | 'func' id tparams? sig block? ';' | 'func' '(' param ','? ')' id sig block? ';'
decl: 'var' vspec | 'var' '(' ')' | 'var' '(' vspec % ';' ';'? ')' | 'const' cspec | 'const' '(' ')' | 'const' '(' cspec % ';' ';'? ')' | 'type' tspec | 'type' '(' ')' | 'type' '(' tspec % ';' ';'? ')'
vspec: id % ',' type | id % ',' type? '=' expr % ','
cspec: id % ',' | id % ',' type? '=' expr % ','
tspec: id tparams? '='? type
tparams: '[' (id % ',' cons) % ',' ']'
cons: '~'? type ('|' '~'? type)*
sig: '(' ')' result? | '(' param % ',' ','? ')' result?
result: type | '(' param % ',' ','? ')'
param: type | id '...'? type | '...' type
type: qual | qual '[' type % ',' ']' | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' sig | 'struct' '{' (field % ';' ';'?)? '}' | 'interface' '{' (elem % ';' ';'?)? '}' | '(' type ')'
qual: id | id '.' id
field: id % ',' type '"'? | '*'? qual '"'?
elem: id sig | cons
block: '{' '}' | '{' stmts '}'
stmts: stmt | ';' | stmts ';' | stmts ';' stmt
stmt: decl | simple | 'return' (expr % ',')? | 'break' id? | 'continue' id? | 'goto' id | 'fallthrough' | 'go' expr | 'defer' expr | block | ifx | forx | switch | 'select' '{' clause* '}' | id ':' stmt?
simple: expr | expr '<-' expr | expr ('++' | '--') | expr % ',' asg expr % ',' | expr % ',' (':=' | '=') 'range' expr
asg: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
ifx: 'if' (simple ';')? expr block ('else' (ifx | block))?
forx: 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' (expr % ',' (':=' | '='))? 'range' expr block
switch: 'switch' (simple? ';')? simple? '{' clause* '}'
clause: ('case' caseitem % ',' | 'default') ':' stmts?
caseitem: expr | type | simple
expr: unary | expr bop unary
bop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||' | '&^'
unary: prim | ('!' | '+' | '-' | '*' | '&' | '^' | '<-') unary
prim: id | '0' | '"' | '(' expr ')' | 'func' sig block | prim '.' id | prim '.' '(' (type | 'type') ')' | prim '[' expr ']' | prim '[' type % ',' ']' | prim '[' expr? ':' expr? ']' | prim '[' expr? ':' expr ':' expr ']' | prim '(' ')' | prim '(' (expr | type) % ',' '...'? ','? ')' | lit
lit: ltype '{' '}' | ltype '{' (kv % ',' ','?) '}'
ltype: qual | qual '[' type % ',' ']' | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'struct' '{' (field % ';' ';'?)? '}'
kv: val | val ':' val
val: expr | '{' '}' | '{' (kv % ',' ','?) '}'
"""

RUST = r"""
program: inner* item+ | inner+
inner: '#' '!' '[' tts? ']'
attr: '#' '[' tts? ']'
id: 'a' | 'union' | 'self'
vis: 'pub' | 'pub' '(' tts ')'
item: attr* vis? raw | macro ';' | idmac '{' tts? '}' | attr* idmac '{' tts? '}'
raw: 'use' usetree ';' | 'extern' 'crate' id ';' | 'mod' id ';' | 'mod' id '{' inner* item* '}' | fn | 'struct' id gens? where? '{' (field % ',' ','?)? '}' | 'struct' id gens? ('(' (tfield % ',' ','?)? ')')? where? ';' | 'union' id gens? '{' (field % ',' ','?)? '}'
  | 'enum' id gens? where? '{' (variant % ',' ','?)? '}' | 'unsafe'? 'impl' gens? ('!'? type 'for')? type where? '{' inner* member* '}' | 'unsafe'? 'trait' id gens? (':' bounds?)? where? '{' member* '}'
  | 'const' (id | '_') ':' type '=' expr ';' | 'static' 'mut'? id ':' type '=' expr ';' | 'type' id gens? (':' bounds)? where? ('=' type)? ';' | 'extern' '"'? '{' member* '}'
usetree: path | path 'as' (id | '_') | path '::' '*' | '*' | path '::' usegroup | '::'? usegroup
usegroup: '{' '}' | '{' usetree % ',' ','? '}'
path: seg | '::' seg | path '::' seg
seg: id | 'super' | 'crate'
member: attr* vis? 'default'? (fn | 'const' id ':' type ('=' expr)? ';' | 'type' id gens? (':' bounds)? where? ('=' type where?)? ';' | 'static' 'mut'? id ':' type ';') | macro ';' | idmac '{' tts? '}'
fn: fmod* 'fn' id gens? '(' (param % ',' ','?)? ')' ('->' type)? where? (block | ';')
fmod: 'const' | 'async' | 'unsafe' | 'extern' '"'?
param: attr* pat ':' type | '&' life? 'mut'? 'self' | 'mut'? 'self' (':' type)? | '...' | type
field: attr* vis? id ':' type
tfield: attr* vis? type
variant: attr* id ('(' (tfield % ',' ','?)? ')' | '{' (field % ',' ','?)? '}')? ('=' expr)?
life: 'life'
gens: '<' '>' | '<' gen % ',' ','? '>'
gen: attr* life (':' life ('+' life)*)? | id (':' bounds?)? ('=' type)? | 'const' id ':' type ('=' expr)?
bounds: bound % '+'
bound: '?'? type | life | 'for' gens type | '(' bound ')'
where: 'where' (wpred % ',' ','?)?
wpred: type ':' bounds? | life ':' bounds | 'for' gens type ':' bounds
type: tpath | '&' life? 'mut'? type | '&&' life? 'mut'? type | '*' ('const' | 'mut') type | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' type % ',' ','? ')' | '!' | '_' | ('dyn' | 'impl') bounds | fmod* 'fn' '(' (fparam % ',' ','?)? ')' ('->' type)? | 'for' gens type | macro
fparam: type | id ':' type
tpath: tseg | '::' tseg | tpath '::' tseg | '<' type ('as' type)? '>' '::' tseg
tseg: seg | seg targs | seg '::' targs | seg '(' (type % ',' ','?)? ')' ('->' type)?
targs: '<' '>' | '<' targ % ',' ','? '>'
targ: type | life | id '=' type | id ':' bounds | '0' | '"' | block | '-' '0'
block: '{' inner* '}' | '{' inner* stmts? tail '}' | '{' inner* stmts '}'
stmts: stmt+
tail: attr* expr
stmt: ';' | item | attr* 'let' pat (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* bexpr
bexpr: block | 'unsafe' block | 'async' 'move'? block | ifx | loopl? ('loop' block | 'while' cond block | 'for' pat 'in' expr block) | loopl block | 'match' expr '{' inner* '}' | 'match' expr '{' arms '}'
loopl: life ':'
ifx: 'if' cond block ('else' (block | ifx))?
cond: expr
arms: arm+ lastarm? | lastarm
arm: attr* pats ('if' expr)? '=>' (expr ',' | bexpr ','?)
lastarm: attr* pats ('if' expr)? '=>' expr
pats: '|'? pat
pat: pat1 | pat '|' pat1
pat1: '_' | '..' | 'ref'? 'mut'? id ('@' pat1)? | plit | plit ('..=' | '..' | '...') plit? | '..=' plit | '&' 'mut'? pat1 | '&&' pat1 | '(' (pat % ',' ','?)? ')' | '[' (pat % ',' ','?)? ']' | tpath '(' (pat % ',' ','?)? ')' | tpath '{' (fpat % ',' ','?)? '}' | macro | 'box' pat1
plit: '0' | '"' | '-' '0' | tpath
fpat: attr* id ':' pat | 'ref'? 'mut'? id | '..' | '0' ':' pat
expr: range | unary asg expr | closure | 'return' expr? | 'break' life? expr? | 'continue' life? | 'let' pat '=' expr
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>='
closure: 'async'? 'move'? ('||' | '|' (cparam % ',' ','?)? '|') ('->' type block | expr)
cparam: attr* pat1 (':' type)?
range: bin | bin ('..' | '..=') bin? | ('..' | '..=') bin?
bin: unary | bin bop unary
bop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '&' | '|' | '^' | '&&' | '||'
unary: post | ('!' | '-' | '*') unary | ('&' | '&&') 'mut'? unary | unary 'as' type | '&' 'raw' ('const' | 'mut') unary | closure
post: prim | post '.' id | post '.' '0' | post '.' 'await' | post '.' id '::' targs args | post args | post '[' expr ']' | post '?'
args: '(' (expr % ',' ','?)? ')'
prim: tpath | '0' | '"' | '(' ')' | '(' expr % ',' ','? ')' | '[' ']' | '[' expr % ',' ','? ']' | '[' expr ';' expr ']' | tpath '{' '}' | tpath '{' (finit % ',' ','?)? ('..' expr?)? '}' | tpath '{' finit % ',' ',' '..' expr '}' | bexpr | macro
finit: attr* id | id ':' expr | '0' ':' expr
macro: idmac '(' tts? ')' | idmac '[' tts? ']' | idmac '{' tts? '}'
idmac: path '!' | path '!' id
tts: tt+
tt: '(' tts? ')' | '[' tts? ']' | '{' tts? '}' | ANY
"""

C = r"""
program: ext+
ext: fundef | decl | ';' | 'a' '(' args? ')' ';'? | 'extern' '"' '{' ext* '}' | 'asm' '(' args ')' ';' | 'static_assert' '(' args ')' ';'
fundef: spec+ fdeclr decl* block | fdeclr block
fdeclr: ptr* fdd
fdd: ddeclr '(' ')' | ddeclr '(' params ')' | '(' fdeclr ')' '(' params? ')'
decl: spec+ (idecl % ',')? ';'
spec: 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | 'const' | 'volatile' | 'restrict' | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | 'bool_' | 'a' | 'a' '(' args? ')' | su | enum
su: ('struct' | 'union') 'a' | ('struct' | 'union') 'a'? '{' sdecl* '}'
sdecl: spec+ (sdeclr % ',')? ';' | ';'
sdeclr: declr (':' cond)? | ':' cond
enum: 'enum' 'a' | 'enum' 'a'? '{' (en % ',' ','?)? '}'
en: 'a' ('=' cond)?
idecl: declr 'a'? ('=' init)?
init: assign | '{' '}' | '{' (dinit % ',' ','?) '}'
dinit: (desig+ '=')? init
desig: '[' cond ']' | '.' 'a'
declr: ptr* ddeclr
ptr: '*' ('const' | 'volatile' | 'restrict')*
ddeclr: 'a' | '(' declr ')' | ddeclr '[' 'static'? assign? ']' | ddeclr '[' '*' ']' | ddeclr '(' ')' | ddeclr '(' params ')'
params: param % ',' (',' '...')?
param: spec+ declr? | spec+ adeclr
adeclr: ptr+ | ptr* dadeclr
dadeclr: '(' adeclr ')' | '[' assign? ']' | '(' params? ')' | dadeclr '[' assign? ']' | dadeclr '(' params? ')'
tname: spec+ adeclr?
block: '{' bitem* '}'
bitem: decl | stmt
stmt: block | ';' | expr ';' | 'a' ':' stmt | 'case' cond ('...' cond)? ':' stmt | 'default' ':' stmt | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' (decl | expr? ';') expr? ';' expr? ')' stmt | 'goto' 'a' ';' | 'continue' ';' | 'break' ';' | 'return' expr? ';' | 'asm' '(' args ')' ';' | 'case' cond ':' decl
expr: assign % ','
assign: cond | unary asg assign
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>='
cond: bin | bin '?' expr? ':' cond
bin: unary | bin bop unary
bop: '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||'
unary: post | ('!' | '~' | '+' | '-' | '*' | '&' | '++' | '--') unary | ('sizeof' | 'alignof') unary | ('sizeof' | 'alignof') '(' tname ')' | '(' tname ')' unary
post: prim | post '[' expr ']' | post '(' args? ')' | post ('.' | '->') 'a' | post ('++' | '--') | '(' tname ')' '{' (dinit % ',' ','?) '}'
prim: 'a' | '0' | str | '(' expr ')' | '(' block ')'
str: ('"' | 'a' '"')+ 'a'?
args: (assign | tname) % ','
"""

RUBY = r"""
program: sep? | sep? stmts
sep: 'nl'+
stmts: stmt | stmts sep | stmts sep stmt
body: sep | sep stmts | stmts
stmt: core | stmt 'if' line | stmt 'unless' line | stmt 'while' line | stmt 'until' line | stmt 'rescue' line | 'alias' fname fname | 'undef' fname | 'BEGIN' '{' body? '}'
core: line
line: expr | line 'and' expr | line 'or' expr | 'not' line
expr: arg | cmd | mlhs '=' (arg | cmd | arg % ',' | splat) | post asg cmd | 'return' cargs? | 'break' cargs? | 'next' cargs? | '!' cmd
mlhs: (post | '*' post) % ','
splat: '*' arg
cmd: post cargs blk? | 'yield' cargs | 'super' cargs | 'defined' arg
cargs: carg % ','
carg: arg | '*' arg | '&' arg | '**' arg | 'L' arg | 'L' | '"' ':' arg | arg '=>' arg | cmd
arg: tern | post asg arg | post asg arg 'rescue' arg | lam
asg: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '||=' | '&&=' | '|=' | '&=' | '<<=' | '>>=' | '^='
tern: rng | rng '?' nlx? arg nlx? ':' nlx? arg | rng '?' nlx? 'L' nlx? arg
nlx: sep
rng: bin | bin ('..' | '...') bin?
bin: unary | bin bop unary
bop: '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<' | '>' | '<=' | '>=' | '<=>' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||'
unary: post | ('!' | '-' | '+' | '~' | '&' ) unary | 'defined' '(' arg ')'
post: prim | post ('.' | '&.' | '::') fname | post ('.' | '&.') '(' args? ')' | post paren | post '[' args? ']' | post blk
paren: '(' ')' | '(' args ')' | '(' nlx args ')'
args: cargs ','? nlx?
blk: '{' bparams? body? '}' | 'do' bparams? body? rescues? 'end'
bparams: '|' params? '|' | '||'
lam: '->' ('(' params? ')' | params)? blk
fname: 'a' | 'class' | 'end' | 'if' | 'next' | 'then' | 'do' | 'in' | 'begin' | 'module' | 'def' | '+' | '-' | '*' | '/' | '==' | '<=>' | '<<' | '[' ']' | '[' ']' '=' | '!' | '%' | '<' | '>' | '"'
params: param % ',' ','?
param: 'a' | 'a' '=' tern | 'L' | 'L' tern | '*' 'a'? | '**' 'a'? | '&' 'a'? | '(' params ')'
then: sep | 'then' | sep 'then'
prim: 'a' | '0' | '"'+ | '[' ']' | '[' nlx? args ']' | '{' nlx? '}' | '{' nlx? pairs nlx? '}' | '(' ')' | '(' body ')' | '::' 'a' | '..' bin
  | 'def' dname ('(' params? ')' | params)? sep body? rescues? 'end' | 'def' dname ('(' params? ')')? '=' stmt | 'def' dname '(' params? ')' stmts sep 'end' | 'class' cpath ('<' line)? sep body? rescues? 'end' | 'class' '<<' arg sep body? 'end' | 'module' cpath sep body? 'end' | 'begin' body? rescues? 'end'
  | ('if' | 'unless') line then body? elsifs? ('else' body?)? 'end' | ('while' | 'until') line ('do' | sep) body? 'end' | 'for' mlhs 'in' line ('do' | sep) body? 'end' | 'case' line? sep? whens ('else' body?)? 'end' | 'yield' | 'yield' paren | 'super' | 'retry' | 'redo' | 'self_'
dname: fname | ('a' | 'self_') '.' fname | fname '='
cpath: 'a' | cpath '::' 'a'
elsifs: ('elsif' line then body?)+
whens: (('when' | 'in') (cargs) then body?)+
rescues: rescue+ ('else' body?)? ('ensure' body?)? | 'ensure' body?
rescue: 'rescue' (cargs)? ('=>' 'a')? then body?
pairs: pair | pairs nlx? ',' nlx? pair | pairs ','
pair: 'L' nlx? arg | 'L' | arg '=>' nlx? arg | '"' ':' arg | '**' arg
"""

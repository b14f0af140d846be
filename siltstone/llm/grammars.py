"""Token classes and grammars of the languages whose syntax is checked."""

from __future__ import annotations

import re

from siltstone.llm.derivatives import Grammar

# An open end takes the rest of the text, once, and is no valid token.
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)"
_OPEN = (r"/\*(?!(?s:.*)\*/\Z)", "ERROR")
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][-+]?\d[\d_]*)?|\.\d[\d_]*(?:[eE][-+]?\d+)?)"
_BAD = "ERROR"

EXPR_JS = """
expr = assign { ',' assign } ;
assign = arrow | cond ;
cond = unary { binop unary } [ '?' assign ':' assign ] | unary { binop unary } binop arrow | unary { binop unary } '?' assign ':' arrow ;
arrow = [ 'async' ] ( ident | [ tparams ] '(' [ params ] ')' [ rettype ] ) '=>' ( !'{' assign | block ) ;
unary = { prefix } postfix ;
prefix = '!' | '-' | '+' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | 'yield' ;
postfix = primary { '.' anyname | '?.' ( anyname | '[' expr ']' | args ) | '[' expr ']' | args | TEMPLATE | '++' | '--' | postmore } ;
args = '(' [ arg { ',' arg } [ ',' ] ] ')' ;
arg = [ '...' ] assign ;
primary = ident | NUM | STR | TEMPLATE | REGEX | 'this' | 'null' | 'true' | 'false' | 'super' | '(' expr ')' | array | object | function | class | 'import' [ '.' anyname ] ;
array = '[' { ',' } [ arg { ',' { ',' } arg } { ',' } ] ']' ;
object = '{' [ prop { ',' prop } [ ',' ] ] '}' ;
prop = '...' assign | propname ':' assign | ident [ '=' assign ] | method ;
method = { 'async' | '*' | 'get' | 'set' | 'static' } propname [ tparams ] '(' [ params ] ')' [ rettype ] block ;
propname = anyname | STR | NUM | '[' assign ']' ;
function = [ 'async' ] 'function' [ '*' ] [ ident ] [ tparams ] '(' [ params ] ')' [ rettype ] block ;
class = 'class' [ ident ] [ tparams ] [ 'extends' postfix ] [ implements ] '{' { ';' | member } [ lastmember ] '}' ;
pattern = ident | array | object ;
block = '{' stmts '}' ;
stmts = { closed | simple ';' | ';' } [ open ] ;
open = simple | 'if' '(' expr ')' open | 'if' '(' expr ')' ( sub | simple ) 'else' open | 'for' [ 'await' ] '(' forhead ')' open | 'while' '(' expr ')' open ;
sub = closed | simple ';' | ';' ;
binop = '=' | OPASSIGN | '==' | '&&' | '||' | '??' | '|' | '&' | '^' | '+' | '-' | '*' | '/' | '%' | '**' | '<' | '>' [ '>' [ '>' ] ] [ '>=' ] | '<<' | '<=' | '>=' | 'in' | 'instanceof' ;
closed = block | 'if' '(' expr ')' sub [ 'else' sub ] | 'if' '(' expr ')' simple 'else' sub | 'for' [ 'await' ] '(' forhead ')' sub | 'while' '(' expr ')' sub | 'do' sub 'while' '(' expr ')'
  | 'try' block ( 'catch' [ '(' pattern [ annotation ] ')' ] block [ 'finally' block ] | 'finally' block )
  | 'switch' '(' expr ')' '{' { ( 'case' expr | 'default' ) ':' stmts } '}' | function | class | ident ':' sub | morestmt ;
forhead = [ vardecl | expr ] ';' [ expr ] ';' [ expr ] | ( 'const' | 'let' | 'var' ) pattern ( 'of' | 'in' ) expr | postfix ( 'of' | 'in' ) expr ;
vardecl = ( 'let' | 'var' ) binding { ',' binding } | 'const' cbinding { ',' cbinding } ;
binding = ident [ '!' ] [ annotation ] [ '=' assign ] | pattern [ annotation ] '=' assign ;
cbinding = pattern [ annotation ] '=' assign | ident annotation ;
simple = vardecl | 'return' [ expr ] | 'throw' expr | ( 'break' | 'continue' ) [ ident ] | 'debugger' | !'{' !'function' !'class' expr | module ;
module = 'import' STR | 'import' [ 'type' ] clause 'from' STR | 'export' ( vardecl | [ 'type' ] '*' [ 'as' anyname ] 'from' STR | [ 'type' ] named [ 'from' STR ] | 'default' !'function' !'class' assign | '=' assign | 'as' 'namespace' ident ) | [ 'export' ] 'import' ident '=' assign ;
clause = ident [ ',' ( named | '*' 'as' ident ) ] | named | '*' 'as' ident ;
named = '{' [ spec { ',' spec } [ ',' ] ] '}' ;
spec = [ 'type' ] ( anyname | STR ) [ 'as' ( anyname | STR ) ] ;
file = { closed | simple ';' | ';' | 'export' [ 'default' ] ( function | class | morestmt ) } [ open ] ;
"""
_JS_KEYS = "import export function const var for if return class this throw new await try catch null default true false while break else switch case typeof instanceof in do delete void extends super finally continue debugger".split()
_JS_SOFT = "async of get set from as static let yield".split()
_TS_SOFT = _JS_SOFT + "type declare abstract readonly public private protected interface enum namespace implements keyof is infer satisfies override module unique global".split()

JS_EXTRA = """
lastmember = [ 'static' ] propname [ '=' assign ] ; postmore = NEVER ; rettype = NEVER ; annotation = NEVER ; tparams = NEVER ; implements = NEVER ; morestmt = NEVER ;
params = param { ',' param } [ ',' ] ;
param = [ '...' ] pattern [ '=' assign ] ;
member = method | [ 'static' ] propname [ '=' assign ] ';' | 'static' block ;
"""
TS_EXTRA = """
postmore = 'as' ( type | 'const' ) | 'satisfies' type | '!' | targs ;
rettype = ':' [ [ ident ] ( ident | 'this' ) 'is' ] type | ':' ident ident ;
annotation = ':' type ;
tparams = '<' tparam { ',' tparam } [ ',' ] '>' ;
tparam = [ 'const' ] [ 'in' ] ident [ ident ] [ 'extends' type ] [ '=' type ] ;
implements = 'implements' type { ',' type } ;
params = param { ',' param } [ ',' ] ;
param = { modifier } [ '...' ] ( pattern | 'this' ) [ '?' ] [ annotation ] [ '=' assign ] ;
lastmember = { modifier } ( { 'get' | 'set' } propname [ '?' ] [ tparams ] '(' [ params ] ')' [ rettype ] | propname [ '?' | '!' ] [ annotation ] [ '=' assign ] | '[' ident ':' type ']' ':' type ) ;
modifier = 'public' | 'private' | 'protected' | 'readonly' | 'static' | 'abstract' | 'declare' | 'override' | 'async' ;
member = { decorator } { modifier } ( { '*' | 'get' | 'set' } propname [ '?' ] [ tparams ] '(' [ params ] ')' [ rettype ] ( block | ';' ) | propname [ '?' | '!' ] [ annotation ] [ '=' assign ] ';' | '[' ident ':' type ']' ':' type ';' | block ) ;
decorator = '@' postfix ;
type = [ '|' | '&' ] ptype { ( '|' | '&' ) ptype } [ 'extends' type '?' type ':' type ] ;
ptype = tprim { '[' [ type ] ']' } ;
tprim = qual [ targs ] | STR | NUM | '-' NUM | TEMPLATE | '(' type ')' | [ 'abstract' ] [ 'new' ] [ tparams ] '(' [ params ] ')' '=>' ( type | [ ident ] ( ident | 'this' ) 'is' type | ident ident ) | '{' tmembers '}' | '[' [ telem { ',' telem } [ ',' ] ] ']'
  | 'typeof' ( qual | 'import' '(' STR ')' [ '.' qual ] ) [ targs ] | 'unique' ident | 'keyof' ptype | 'readonly' ptype | 'infer' ident [ 'extends' ptype ] | 'null' | 'void' | 'this' | 'true' | 'false' | 'import' '(' STR ')' [ '.' qual ] [ targs ] ;
telem = [ '...' ] [ ident [ '?' ] ':' ] type ;
targs = '<' type { ',' type } '>' ;
qual = ident { '.' anyname } ;
tmembers = { tmember ( ';' | ',' ) } [ tmember ] ;
tmember = { 'readonly' | '-' | '+' | 'get' | 'set' } ( propname [ '?' ] [ annotation ] | [ propname | 'new' ] [ '?' ] [ tparams ] '(' [ params ] ')' [ rettype ] | '[' ident ( ':' | 'in' [ 'keyof' ] ) type [ 'as' type ] ']' [ '-' | '+' ] [ '?' ] ':' type ) ;
morestmt = [ 'declare' ] ( 'interface' ident [ tparams ] [ 'extends' type { ',' type } ] '{' tmembers '}' | [ 'const' ] 'enum' ident '{' [ ename { ',' ename } [ ',' ] ] '}' | ( 'namespace' | 'module' ) ( qual | STR ) '{' file '}'
  | 'type' ident [ tparams ] '=' type ';' | 'abstract' class | decorator { [ ';' ] decorator } [ ';' ] [ 'export' [ 'default' ] ] [ 'abstract' ] class | [ 'async' ] 'function' [ '*' ] [ ident ] [ tparams ] '(' [ params ] ')' [ rettype ] ';' | 'global' '{' file '}' ) | 'declare' ( [ 'abstract' ] class | ( 'const' | 'let' | 'var' ) dbinding { ',' dbinding } ';' | ( 'module' | 'namespace' ) STR ';' ) ;
dbinding = ident [ annotation ] ;
ename = propname [ '=' assign ] ;
"""

GO = """
file = 'package' IDENT ';' { import ';' } { top ';' } [ top ] ;
import = 'import' ( ispec | '(' { ispec ';' } [ ispec ] ')' ) ;
ispec = [ IDENT | '.' ] STR ;
top = func | decl ;
func = 'func' [ '(' params ')' ] IDENT [ '[' params ']' ] signature [ block ] ;
signature = '(' [ params ] ')' [ type | '(' params ')' ] ;
params = param { ',' param } [ ',' ] ;
param = [ '...' ] type | IDENT [ '...' ] type ;
type = IDENT [ '.' IDENT ] [ '[' type { ',' type } ']' ] | '*' type | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')' ;
struct = 'struct' '{' { field ';' } [ field ] '}' ;
field = IDENT { ',' IDENT } type [ STR ] | [ '*' ] IDENT [ '.' IDENT ] [ STR ] ;
interface = 'interface' '{' { ielem ';' } [ ielem ] '}' ;
ielem = IDENT signature | [ '~' ] type { '|' [ '~' ] type } ;
decl = ( 'var' | 'const' ) ( vspec | '(' { vspec ';' } [ vspec ] ')' ) | 'type' ( tspec | '(' { tspec ';' } [ tspec ] ')' ) ;
vspec = IDENT { ',' IDENT } [ type ] [ '=' exprs ] ;
tspec = IDENT [ '[' params ']' ] [ '=' ] type ;
block = '{' stmts '}' ;
stmts = { [ stmt ] ';' } [ stmt ] ;
stmt = decl | simple | 'return' [ exprs ] | ( 'break' | 'continue' | 'goto' ) [ IDENT ] | 'fallthrough' | block | if | for | switch | select | ( 'go' | 'defer' ) expr | IDENT ':' [ stmt ] ;
simple = exprs [ ( ':=' | '=' | OPASSIGN ) exprs | '++' | '--' | '<-' expr ] ;
if = 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ] ;
for = 'for' [ expr | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( ':=' | '=' ) ] 'range' expr ] block ;
switch = 'switch' [ [ simple ] ';' ] [ simple ] '{' { ( 'case' exprs | 'default' ) ':' stmts } '}' ;
select = 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
exprs = expr { ',' expr } ;
expr = unary { binop unary } ;
unary = { '-' | '!' | '*' | '&' | '^' | '+' | '<-' } primary ;
primary = operand { '.' IDENT | '.' '(' ( type | 'type' ) ')' | '[' [ expr ] [ ':' [ expr ] [ ':' expr ] ] ']' | '[' type ',' type { ',' type } ']' | call | lit } ;
call = '(' [ carg { ',' carg } [ '...' ] [ ',' ] ] ')' ;
carg = expr | type ;
operand = IDENT | NUM | STR | CHAR | '(' expr ')' | 'func' signature block | ctype ( lit | '(' expr [ ',' ] ')' ) | ctype ;
ctype = '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | struct | interface | 'chan' [ '<-' ] type ;
lit = '{' [ elem { ',' elem } [ ',' ] ] '}' ;
elem = [ ( expr | lit ) ':' ] ( expr | lit ) ;
binop = '==' | '&&' | '||' | '|' | '&' | '^' | '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<<' | '>>' | '<=' | '>=' ;
"""

RUST = """
file = { '#' '!' tree } { item } ;
item = { attr } [ vis ] ( 'use' usetree ';' | fn | struct | enum | impl | trait | 'mod' IDENT ( ';' | '{' { item } '}' ) | ( 'const' | 'static' ) [ 'mut' ] IDENT ':' type [ '=' expr ] ';' | 'type' IDENT [ gparams ] [ ':' bounds ] [ where ] [ '=' type ] [ where ] ';' | IDENT IDENT [ gparams ] [ where ] '{' [ sfield { ',' sfield } [ ',' ] ] '}' | 'extern' ( 'crate' ( IDENT | 'self' ) [ 'as' IDENT ] ';' | [ STR ] '{' { item } '}' ) | path '!' [ IDENT ] macro ) ;
macro = mparen ';' | '{' { tt } '}' ;
attr = '#' tree ;
vis = 'pub' [ '(' ( 'crate' | 'super' | 'self' | 'in' path ) ')' ] ;
usetree = [ '::' ] ( useseg { '::' useseg } [ 'as' IDENT ] ) ;
useseg = IDENT | 'crate' | 'self' | 'super' | '*' | '{' [ usetree { ',' usetree } [ ',' ] ] '}' ;
fn = { 'const' | 'async' | 'unsafe' | 'extern' [ STR ] } 'fn' IDENT [ gparams ] '(' [ fparam { ',' fparam } [ ',' ] ] ')' [ '->' type ] [ where ] ( block | ';' ) ;
fparam = { attr } ( [ '&' [ LIFETIME ] ] [ 'mut' ] 'self' [ ':' type ] | pat ':' type | '...' ) ;
gparams = '<' [ gparam { ',' gparam } [ ',' ] ] '>' ;
gparam = ( LIFETIME | [ 'const' ] IDENT ) [ ':' bounds ] [ '=' type ] ;
bounds = [ bound { '+' bound } ] ;
bound = LIFETIME | [ '?' ] type ;
where = 'where' [ clause { ',' clause } [ ',' ] ] ;
clause = [ 'for' gparams ] ( type | LIFETIME ) ':' bounds ;
struct = 'struct' IDENT [ gparams ] [ where ] ( '{' [ sfield { ',' sfield } [ ',' ] ] '}' | '(' [ tfield { ',' tfield } [ ',' ] ] ')' [ where ] ';' | ';' ) ;
sfield = { attr } [ vis ] IDENT ':' type ;
tfield = { attr } [ vis ] type ;
enum = 'enum' IDENT [ gparams ] [ where ] '{' [ variant { ',' variant } [ ',' ] ] '}' ;
variant = { attr } IDENT [ '{' [ sfield { ',' sfield } [ ',' ] ] '}' | '(' [ tfield { ',' tfield } [ ',' ] ] ')' ] [ '=' expr ] ;
impl = [ 'unsafe' ] 'impl' [ gparams ] [ '!' ] type [ 'for' type ] [ where ] '{' { item } '}' ;
trait = [ 'unsafe' ] 'trait' IDENT [ gparams ] [ ':' bounds ] [ where ] '{' { item } '}' ;
type = '&' [ LIFETIME ] [ 'mut' ] type | '&&' type | tpath | '[' type [ ';' expr ] ']' | '(' [ type { ',' type } [ ',' ] ] ')' | [ 'unsafe' ] [ 'extern' [ STR ] ] 'fn' '(' [ fnarg { ',' fnarg } [ ',' ] ] ')' [ '->' type ] | 'for' gparams type | '<' type [ 'as' type ] '>' '::' tseg { '::' tseg } | [ '::' ] tseg { '::' tseg } '!' mtree | 'impl' bounds | 'dyn' bounds | '*' ( 'const' | 'mut' ) type | '!' ;
fnarg = { attr } ( [ IDENT ':' ] type | '...' ) ;
tpath = [ '::' ] tseg { '::' tseg } ;
tseg = ( IDENT | 'self' | 'crate' | 'super' ) [ [ '::' ] targs | '(' [ type { ',' type } ] ')' [ '->' type ] ] ;
targs = '<' [ targ { ',' targ } [ ',' ] ] '>' ;
targ = LIFETIME | type | IDENT [ targs ] ( '=' type | ':' bounds ) | [ '-' ] NUM | STR | CHAR | 'true' | 'false' | block ;
pat = [ '|' ] pat1 { '|' pat1 } ;
pat1 = [ 'ref' ] [ 'mut' ] IDENT [ '@' pat1 ] | ppath [ '(' [ pat { ',' pat } [ ',' ] ] ')' | '{' [ fpat { ',' fpat } [ ',' ] ] '}' ] | plit [ ( '..' | '..=' ) [ plit ] ] | ( '..' | '..=' ) [ plit ] | '&' [ 'mut' ] pat1 | '(' [ pat { ',' pat } [ ',' ] ] ')' | '[' [ pat { ',' pat } [ ',' ] ] ']' ;
plit = [ '-' ] NUM | STR | CHAR | 'true' | 'false' | ppath ;
ppath = ( IDENT | 'self' | 'crate' | 'super' ) { '::' IDENT } ;
fpat = '..' | [ 'ref' ] [ 'mut' ] IDENT [ ':' pat ] ;
block = '{' { '#' '!' tree } stmts '}' ;
stmts = { item | { attr } 'let' pat [ ':' type ] [ '=' expr [ 'else' block ] ] ';' | { attr } !'{' expr ';' | { attr } blockexpr | ';' } [ { attr } expr ] ;
blockexpr = [ LIFETIME ':' ] ( block | 'unsafe' block | 'async' [ 'move' ] block | if | 'match' expr '{' [ arm { arm } [ lastarm ] | lastarm ] '}' | 'loop' block | 'while' cond block | 'for' pat 'in' expr block ) | path '!' '{' { tt } '}' ;
if = 'if' cond block [ 'else' ( if | block ) ] ;
cond = expr | 'let' pat '=' expr { '&&' ( expr | 'let' pat '=' expr ) } ;
arm = { attr } pat [ 'if' expr ] '=>' ( expr ',' | blockexpr [ ',' ] ) ;
lastarm = { attr } pat [ 'if' expr ] '=>' expr ;
expr = unary { binop unary } [ '..' [ unary { binop unary } ] ] | ( '..' | '..=' ) [ unary { binop unary } ] ;
unary = { '-' | '!' | '*' | '&' [ 'mut' ] | '&&' [ 'mut' ] } ( postfix { 'as' type } | jump | closure ) ;
jump = 'return' [ expr ] | 'break' [ LIFETIME ] [ expr ] | 'continue' [ LIFETIME ] ;
closure = [ 'static' ] [ 'async' ] [ 'move' ] ( '||' | '|' [ cparam { ',' cparam } ] '|' ) ( expr | '->' type block ) ;
cparam = pat1 [ ':' type ] ;
postfix = primary { '.' ( IDENT [ '::' targs ] | NUM | 'await' ) | '(' [ expr { ',' expr } [ ',' ] ] ')' | '[' expr ']' | '?' } ;
primary = path [ '!' mtree | '{' [ finit { ',' finit } [ ',' [ '..' expr ] ] | '..' expr ] '}' ] | NUM | STR | CHAR | 'true' | 'false' | '(' [ expr { ',' expr } [ ',' ] ] ')' | '[' [ expr ( ';' expr | { ',' expr } [ ',' ] ) ] ']' | blockexpr ;
finit = { attr } ( IDENT [ ':' expr ] | NUM ':' expr ) ;
path = [ '::' ] pseg { '::' pseg } | '<' type [ 'as' type ] '>' '::' pseg { '::' pseg } ;
pseg = IDENT | 'self' | 'crate' | 'super' | targs ;
binop = '=' | OPASSIGN | '==' | '&&' | '||' | '|' | '&' | '^' | '+' | '-' | '*' | '/' | '%' | '<' [ '<' ] | '>' [ '>' ] [ '>=' ] | '<=' | '>=' | '..=' ;
tree = '(' { tt } ')' | '[' { tt } ']' | '{' { tt } '}' ;
mtree = tree ;
mparen = '(' { tt } ')' | '[' { tt } ']' ;
tt = tree | anytok ;
"""

JAVA = """
file = [ { annotation } 'package' qual ';' ] { 'import' [ 'static' ] qual [ '.' '*' ] ';' } { typedecl | ';' } ;
qual = IDENT { '.' IDENT } ;
mods = { annotation | MODIFIER | 'static' | 'final' | 'default' | 'synchronized' } ;
annotation = '@' qual [ '(' [ aval { ',' aval } ] ')' ] ;
aval = [ IDENT '=' ] ( expr | annotation | '{' [ ( expr | annotation ) { ',' ( expr | annotation ) } [ ',' ] ] '}' ) ;
typedecl = mods ( class | interface | enum | record ) ;
class = 'class' IDENT [ tparams ] [ 'extends' type ] [ 'implements' type { ',' type } ] [ 'permits' type { ',' type } ] body ;
record = 'record' IDENT [ tparams ] '(' [ params ] ')' [ 'implements' type { ',' type } ] body ;
interface = [ '@' ] 'interface' IDENT [ tparams ] [ 'extends' type { ',' type } ] [ 'permits' type { ',' type } ] body ;
enum = 'enum' IDENT [ 'implements' type { ',' type } ] '{' [ econst { ',' econst } [ ',' ] ] [ ';' { member } ] '}' ;
econst = { annotation } IDENT [ args ] [ body ] ;
body = '{' { member } '}' ;
member = ';' | typedecl | mods ( block | [ tparams ] ( type | 'void' ) IDENT ( '(' [ params ] ')' { '[' ']' } [ throws ] [ 'default' expr ] ( block | ';' ) | dims [ '=' init ] { ',' IDENT dims [ '=' init ] } ';' ) | [ tparams ] IDENT '(' [ params ] ')' [ throws ] block ) ;
throws = 'throws' type { ',' type } ;
params = param { ',' param } ;
param = mods type [ '...' ] ( IDENT | 'this' ) dims ;
dims = { '[' ']' } ;
tparams = '<' tparam { ',' tparam } '>' ;
tparam = IDENT [ 'extends' type { '&' type } ] ;
type = ( PRIM | IDENT [ targs ] { '.' IDENT [ targs ] } ) { '[' ']' } ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | '?' [ ( 'extends' | 'super' ) type ] ;
block = '{' { bstmt } '}' ;
bstmt = localvar ';' | typedecl | stmt ;
localvar = { annotation | 'final' } type vinit { ',' vinit } ;
vinit = IDENT dims [ '=' init ] ;
init = expr | '{' [ init { ',' init } [ ',' ] ] '}' ;
stmt = block | ';' | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'for' '(' forhead ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'return' [ expr ] ';' | 'throw' expr ';' | ( 'break' | 'continue' ) [ IDENT ] ';'
  | 'try' [ '(' resource { ';' resource } [ ';' ] ')' ] block { 'catch' '(' [ 'final' ] type { '|' type } IDENT ')' block } [ 'finally' block ] | 'switch' '(' expr ')' swbody | 'synchronized' '(' expr ')' block | IDENT ':' stmt | 'assert' expr [ ':' expr ] ';' | exprstmt ';' ;
exprstmt = { '++' | '--' } postfix [ assignop expr ] ;
resource = [ 'final' ] type IDENT '=' expr | qual ;
forhead = [ localvar | expr { ',' expr } ] ';' [ expr ] ';' [ expr { ',' expr } ] | [ 'final' ] type IDENT ':' expr ;
swbody = '{' { ( 'case' citem { ',' citem } | 'default' ) ( ':' { bstmt } | '->' ( expr ';' | block | 'throw' expr ';' ) ) } '}' ;
citem = expr | pattern [ 'when' expr ] | 'default' ;
pattern = [ 'final' ] type ( IDENT | '(' [ pattern { ',' pattern } ] ')' [ IDENT ] ) ;
expr = lambda | unary { binop unary } [ '?' expr ':' expr ] [ assignop expr ] | unary { binop unary } 'instanceof' ( [ 'final' ] type [ IDENT ] | pattern ) { binop unary } [ '?' expr ':' expr ] ;
lambda = ( IDENT | '(' [ lparam { ',' lparam } ] ')' ) '->' ( expr | block ) ;
lparam = [ 'final' ] [ type ] IDENT ;
unary = { '-' | '+' | '!' | '~' | '++' | '--' | '(' type { '&' type } ')' } postfix | { '(' type ')' } lambda ;
postfix = primary { '.' ( [ targs ] IDENT | 'new' creator | 'class' | 'this' | 'super' ) | '[' expr ']' | args | '++' | '--' | '::' ( IDENT | 'new' ) } ;
args = '(' [ expr { ',' expr } ] ')' ;
primary = IDENT | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' creator | ( PRIM | 'void' ) { '[' ']' } ( '.' 'class' | '::' 'new' ) | IDENT [ targs ] { '[' ']' } '::' 'new' | 'switch' '(' expr ')' swbody ;
creator = ctype ( args [ body ] | '[' ']' dims '{' [ init { ',' init } [ ',' ] ] '}' | '[' expr ']' { '[' [ expr ] ']' } ) ;
ctype = PRIM | IDENT [ targs ] { '.' IDENT [ targs ] } ;
assignop = '=' | OPASSIGN | '>' '>=' ;
binop = '==' | '&&' | '||' | '|' | '&' | '^' | '+' | '-' | '*' | '/' | '%' | '<' | '<<' | '>' [ '>' [ '>' ] ] | '<=' | '>=' ;
"""

CPP = """
file = { decl } ;
decl = ';' | 'friend' ( decl | [ 'class' | 'struct' | 'typename' ] qid ';' ) | { spec } ( 'class' | 'struct' | 'union' | 'enum' [ 'class' | 'struct' ] ) qid [ ':' type ] ';' | [ 'inline' ] 'namespace' [ qid ] '{' { decl } '}' | 'using' ( 'namespace' qid | IDENT '=' type | [ 'typename' ] qid ) ';' | 'typedef' dspec declarator ';' | 'template' '<' [ tparam { ',' tparam } ] '>' decl | 'extern' STR ( '{' { decl } '}' | decl ) | 'static_assert' '(' expr { ',' expr } ')' ';'
  | { spec } record [ initdecl { ',' initdecl } ] ';' | { spec } enum [ initdecl { ',' initdecl } ] ';' | function | vardecl ';' | ctor ;
tparam = 'template' '<' [ tparam { ',' tparam } ] '>' ( 'class' | 'typename' ) [ '...' ] [ IDENT ] | ( 'typename' | 'class' ) [ '...' ] [ IDENT ] [ '=' type ] | type [ IDENT ] [ '=' unary ] ;
spec = SPEC | 'static' | 'const' | 'inline' | 'extern' | '[' '[' qid ']' ']' ;
record = ( 'class' | 'struct' | 'union' ) [ IDENT ] [ qid ] [ 'final' ] [ ':' base { ',' base } ] '{' { cmember } '}' ;
base = { ACCESS | SPEC } qid ;
cmember = ACCESS ':' | 'friend' decl | decl ;
enum = 'enum' [ 'class' | 'struct' ] [ IDENT ] [ ':' type ] '{' [ IDENT [ '=' expr ] { ',' IDENT [ '=' expr ] } [ ',' ] ] '}' ;
dspec = { spec } tname { 'const' | SPEC } ;
tname = 'auto' | BUILTIN { BUILTIN } | [ 'typename' | 'struct' | 'class' | 'enum' ] qid | 'decltype' '(' expr ')' ;
type = { 'const' | SPEC } tname { 'const' } { ptr } [ '(' [ type { ',' type } ] ')' ] ;
ptr = '*' | '&' | '&&' | 'const' | '[' [ expr ] ']' ;
declarator = { '*' | '&' | '&&' | 'const' } ( qid | '[' IDENT { ',' IDENT } ']' | '(' { '*' | '&' } [ IDENT ] ')' '(' [ params ] ')' ) { '[' [ expr ] ']' } ;
initdecl = declarator [ '=' init | '(' [ exprs ] ')' | braces ] ;
init = expr | braces ;
braces = '{' [ binit { ',' binit } [ ',' ] ] '}' ;
binit = [ '.' IDENT '=' ] ( expr | braces ) ;
vardecl = dspec initdecl { ',' initdecl } ;
function = dspec { '*' | '&' | '&&' } ( qid | opname ) '(' [ params ] ')' ftail ;
opname = { qid '::' } 'operator' ( '(' ')' | '[' ']' | binop | '=' | OPASSIGN | ',' | '!' | '~' | '++' | '--' | '->' | STR IDENT | 'new' [ '[' ']' ] | 'delete' [ '[' ']' ] | type ) ;
ftail = { 'const' | '&' | '&&' | 'noexcept' [ '(' expr ')' ] | SPEC } [ '->' type ] ( ';' | '=' ( 'default' | 'delete' | NUM ) ';' | block ) ;
ctor = { spec } [ '~' ] qid '(' [ params ] ')' { 'noexcept' [ '(' expr ')' ] | SPEC } [ '->' type ] ( ';' | '=' ( 'default' | 'delete' ) ';' | [ ':' minit { ',' minit } ] block ) ;
minit = qid ( '(' [ exprs ] ')' | braces ) ;
params = param { ',' param } [ ',' '...' ] | '...' ;
param = dspec { '*' | '&' | '&&' | 'const' } [ '...' ] [ IDENT | '(' '*' [ IDENT ] ')' '(' [ params ] ')' ] { '[' [ expr ] ']' } [ '=' init ] ;
qid = [ '::' ] IDENT [ targs ] { '::' [ '~' | 'template' ] IDENT [ targs ] } ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type [ '...' ] | unary ;
block = '{' { stmt } '}' ;
stmt = block | ';' | 'if' [ 'constexpr' ] '(' [ vardecl ';' ] cond ')' stmt [ 'else' stmt ] | 'for' '(' forhead ')' stmt | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'return' [ init ] ';' | 'break' ';' | 'continue' ';' | 'goto' IDENT ';'
  | 'switch' '(' cond ')' stmt | ( 'case' expr | 'default' ) ':' | IDENT ':' stmt | 'try' block { 'catch' '(' ( param | '...' ) ')' block } | vardecl ';' | expr ';' | { spec } record ';' | 'using' qid [ '=' type ] ';' | 'throw' [ expr ] ';' ;
cond = expr | vardecl ;
forhead = ( [ vardecl | exprs ] ) ';' [ cond ] ';' [ exprs ] | dspec { '*' | '&' | '&&' } ( IDENT | '[' IDENT { ',' IDENT } ']' ) ':' init ;
exprs = ( expr | braces ) { ',' ( expr | braces ) } ;
expr = unary { binop unary } [ '?' expr ':' expr ] [ ( '=' | OPASSIGN ) init ] ;
unary = { '-' | '+' | '!' | '~' | '++' | '--' | '*' | '&' | 'sizeof' | 'delete' [ '[' ']' ] | '(' type ')' } postfix ;
postfix = primary { ( '.' | '->' ) [ 'template' | '~' ] qid | '[' expr ']' | '(' [ exprs ] ')' | '++' | '--' | braces } ;
primary = qid | opname | 'noexcept' '(' expr ')' | NUM | STR { STR } | CHAR | 'true' | 'false' | 'nullptr' | 'this' | '(' expr { ',' expr } ')' | 'new' type [ '(' [ exprs ] ')' | braces ] | CAST '<' type '>' '(' expr ')' | BUILTIN { BUILTIN } ( '(' [ expr ] ')' | braces ) | lambda | 'sizeof' '(' type ')' | 'throw' expr | 'auto' '(' expr ')' ;
lambda = '[' [ capture { ',' capture } ] ']' [ '(' [ params ] ')' ] { SPEC | 'noexcept' } [ '->' type ] block ;
capture = '&' [ IDENT ] | '=' | [ '*' ] 'this' | IDENT [ '=' expr ] ;
binop = '==' | '&&' | '||' | '|' | '&' | '^' | '+' | '-' | '*' | '/' | '%' | '<' | '<<' | '>' [ '>' ] | '<=' | '>=' | '<=>' ;
"""

SQL = """
file = { ';' } [ stmt { ';' { ';' } stmt } { ';' } ] ;
stmt = query | insert | update | delete | create | alter | drop | 'GRANT' privs 'ON' object 'TO' names [ 'WITH' 'GRANT' NAME ] | 'REVOKE' privs 'ON' object 'FROM' names [ NAME ] | merge | ( 'BEGIN' | 'COMMIT' | 'ROLLBACK' ) [ 'TRANSACTION' | 'WORK' ] | 'SET' name ( '=' | 'TO' ) expr { ',' expr } | 'TRUNCATE' [ 'TABLE' ] name | 'USE' name | 'ANALYZE' [ name ] | 'EXPLAIN' stmt ;
privs = priv { ',' priv } ;
priv = name | 'SELECT' | 'INSERT' | 'UPDATE' | 'DELETE' | 'ALL' [ NAME ] ;
object = [ 'TABLE' | 'SCHEMA' | 'DATABASE' | 'SEQUENCE' ] names | 'ALL' NAME 'IN' 'SCHEMA' name ;
merge = 'MERGE' 'INTO' name [ [ 'AS' ] NAME ] 'USING' source 'ON' expr when { when } ;
when = 'WHEN' [ 'NOT' ] 'MATCHED' [ 'AND' expr ] 'THEN' ( 'UPDATE' 'SET' sets | 'DELETE' | 'DO' 'NOTHING' | 'INSERT' [ '(' names ')' ] 'VALUES' row ) ;
names = name { ',' name } ;
query = [ 'WITH' [ 'RECURSIVE' ] cte { ',' cte } ] select { ( 'UNION' | 'EXCEPT' | 'INTERSECT' ) [ 'ALL' | 'DISTINCT' ] select } [ order ] [ limit ] ;
cte = name [ '(' names ')' ] 'AS' '(' query ')' ;
select = 'SELECT' [ 'DISTINCT' | 'ALL' ] sitem { ',' sitem } [ 'FROM' from { ',' from } ] [ 'WHERE' expr ] [ 'GROUP' 'BY' exprs ] [ 'HAVING' expr ] | 'VALUES' row { ',' row } | '(' query ')' ;
sitem = '*' | name '.' '*' | expr [ [ 'AS' ] name ] ;
from = source { [ 'INNER' | ( 'LEFT' | 'RIGHT' | 'FULL' ) [ 'OUTER' ] | 'CROSS' | 'NATURAL' ] 'JOIN' source [ 'ON' expr | 'USING' '(' names ')' ] } ;
source = ( name | '(' query ')' | name '(' [ exprs ] ')' ) [ [ 'AS' ] NAME [ '(' names ')' ] ] ;
order = 'ORDER' 'BY' oitem { ',' oitem } ;
oitem = expr [ 'ASC' | 'DESC' ] [ 'NULLS' ( 'FIRST' | 'LAST' ) ] ;
limit = 'LIMIT' expr [ ( 'OFFSET' | ',' ) expr ] | 'OFFSET' expr ;
insert = 'INSERT' 'INTO' name [ '(' names ')' ] ( 'VALUES' row { ',' row } | query | 'DEFAULT' 'VALUES' ) [ 'ON' 'CONFLICT' [ '(' names ')' ] 'DO' ( 'NOTHING' | 'UPDATE' 'SET' sets [ 'WHERE' expr ] ) ] [ 'RETURNING' ( '*' | exprs ) ] ;
row = '(' [ exprs ] ')' ;
update = 'UPDATE' name [ [ 'AS' ] NAME ] 'SET' sets [ 'FROM' from ] [ 'WHERE' expr ] ;
sets = set { ',' set } ;
set = name '=' expr ;
delete = 'DELETE' 'FROM' name [ 'WHERE' expr ] ;
create = 'CREATE' [ 'OR' 'REPLACE' ] [ 'TEMPORARY' | 'TEMP' ] 'TABLE' [ 'IF' 'NOT' 'EXISTS' ] name ( '(' col { ',' col } ')' | 'AS' query ) | 'CREATE' [ 'UNIQUE' ] 'INDEX' [ 'IF' 'NOT' 'EXISTS' ] name 'ON' name '(' oitem { ',' oitem } ')' [ 'WHERE' expr ]
  | 'CREATE' [ 'OR' 'REPLACE' ] 'VIEW' name [ '(' names ')' ] 'AS' query | 'CREATE' ( 'USER' | 'ROLE' ) name { [ 'WITH' ] 'PASSWORD' STR | 'IDENTIFIED' 'BY' STR | [ 'WITH' ] NAME } | 'CREATE' ( 'DATABASE' | 'SCHEMA' | 'SEQUENCE' ) [ 'IF' 'NOT' 'EXISTS' ] name ;
col = name coltype { constraint } | [ 'CONSTRAINT' name ] ( 'PRIMARY' 'KEY' '(' names ')' | 'UNIQUE' '(' names ')' | 'FOREIGN' 'KEY' '(' names ')' refs | 'CHECK' '(' expr ')' ) ;
coltype = NAME { NAME } [ '(' NUM [ ',' NUM ] ')' ] [ NAME { NAME } ] ;
constraint = [ 'NOT' ] 'NULL' | 'DEFAULT' expr | 'PRIMARY' 'KEY' | 'UNIQUE' | refs | 'CHECK' '(' expr ')' ;
refs = 'REFERENCES' name [ '(' names ')' ] { 'ON' ( 'DELETE' | 'UPDATE' ) ( NAME | 'SET' 'NULL' ) } ;
alter = 'ALTER' ( 'TABLE' name aact { ',' aact } | ( 'USER' | 'ROLE' ) name { [ 'WITH' ] 'PASSWORD' STR | 'IDENTIFIED' 'BY' STR | NAME } ) ;
aact = 'ADD' [ 'COLUMN' ] col | 'DROP' [ 'COLUMN' ] name | 'RENAME' [ 'COLUMN' ] [ name ] 'TO' name | 'ALTER' [ 'COLUMN' ] name NAME coltype ;
drop = 'DROP' ( 'TABLE' | 'VIEW' | 'INDEX' | 'USER' | 'ROLE' | 'DATABASE' | 'SCHEMA' | 'SEQUENCE' ) [ 'IF' 'EXISTS' ] names [ NAME ] ;
name = anyn { '.' anyn } ;
anyn = NAME | 'MATCHED' | 'USER' | 'ROLE' | 'FIRST' | 'LAST' | 'TEMP' | 'COLUMN' | 'PASSWORD' | 'WORK' | 'INDEX' | 'KEY' ;
exprs = expr { ',' expr } ;
expr = not { ( 'AND' | 'OR' ) not } ;
not = { 'NOT' } cmp ;
cmp = arith { CMP arith | '=' arith | [ 'NOT' ] 'IN' '(' ( query | exprs ) ')' | [ 'NOT' ] 'LIKE' arith | [ 'NOT' ] 'BETWEEN' arith 'AND' arith | 'IS' [ 'NOT' ] ( 'NULL' | 'TRUE' | 'FALSE' ) } ;
arith = term { ( '+' | '-' | '*' | '/' | '%' | '||' ) term } ;
term = { '-' | '+' } prim [ '::' coltype ] ;
prim = NUM | STR { STR } | 'NULL' | 'TRUE' | 'FALSE' | name [ '(' [ '*' | [ 'DISTINCT' ] exprs [ order ] ] ')' [ 'OVER' '(' [ 'PARTITION' 'BY' exprs ] [ order ] ')' ] ] | '(' ( exprs | query ) ')' | 'EXISTS' '(' query ')' | 'CASE' [ expr ] 'WHEN' expr 'THEN' expr { 'WHEN' expr 'THEN' expr } [ 'ELSE' expr ] 'END' | 'CAST' '(' expr 'AS' coltype ')' | 'DEFAULT' | 'INTERVAL' STR [ NAME ] | '?' | ':' NAME ;
"""

BASH = """
file = { NL } [ list ] ;
list = andor { sep andor } [ sep ] ;
sep = ( ';' | '&' | NL ) { NL } ;
andor = pipe { ( '&&' | '||' ) { NL } pipe } ;
pipe = [ '!' ] cmd { ( '|' | '|&' ) { NL } cmd } ;
cmd = simple | compound { redir } | word '(' ')' { NL } compound { redir } | 'function' word [ '(' ')' ] { NL } compound ;
simple = first { word | redir | kw } | redir { redir } [ first { word | redir | kw } ] ;
first = WORD | 'in' | ARRAY { WORD } ;
word = WORD | 'in' | ARRAY ;
kw = 'if' | 'then' | 'fi' | 'for' | 'do' | 'done' | 'while' | 'until' | 'case' | 'esac' | 'else' | 'elif' | 'function' | 'select' | '!' | '{' | '}' | 'time' ;
redir = REDIR ( word | kw ) | REDIRDUP | HEREDOC ;
compound = '{' { NL } list '}' | '(' { NL } list ')' | 'if' { NL } list 'then' { NL } list { 'elif' { NL } list 'then' { NL } list } [ 'else' { NL } list ] 'fi' | 'for' WORD [ { NL } 'in' { word | kw } ] [ ';' | NL ] { NL } 'do' { NL } list 'done' | 'for' ARITH [ ';' ] { NL } 'do' { NL } list 'done'
  | ( 'while' | 'until' ) { NL } list 'do' { NL } list 'done' | 'case' word { NL } 'in' { NL } { [ '(' ] ( word | kw ) { '|' word } ')' { NL } [ list ] [ ( ';;' | ';&' ) { NL } ] } 'esac' | 'select' WORD [ 'in' { word } ] sep 'do' { NL } list 'done' | TEST | ARITH ;
"""

JSON = """
file = value ;
value = STR | NUM | 'true' | 'false' | 'null' | '{' [ STR ':' value { ',' STR ':' value } ] '}' | '[' [ value { ',' value } ] ']' ;
"""

YAML = """
file = { DOC } [ node { DOC { DOC } [ node ] } ] ;
node = map | list | SCALAR { SCALAR } ;
map = entry { entry } ;
entry = KEYVAL [ INDENT SCALAR { SCALAR } DEDENT ] | KEY [ INDENT node DEDENT | list | KEYVALLIST ] | BLOCKKEY ;
list = litem { litem } ;
litem = ITEM | ITEMKEYVAL [ INDENT map DEDENT ] | ITEMKEY [ INDENT ( map | list | INDENT node DEDENT [ map ] ) DEDENT ] | DASH [ INDENT node DEDENT ] | BLOCKITEM ;
"""

PYTHON = """
file = { NL | stmt } ;
stmt = simple { ';' simple } [ ';' ] NL | compound ;
suite = simple { ';' simple } [ ';' ] NL | NL INDENT stmt { stmt } DEDENT ;
simple = targets { targets } ( exprs | yield ) | target ':' expr [ '=' ( exprs | yield ) ] | target OPASSIGN ( exprs | yield ) | exprs | yield | 'pass' | 'break' | 'continue' | 'return' [ exprs ] | 'raise' [ expr [ 'from' expr ] ] | 'assert' expr [ ',' expr ] | 'del' exprs | ( 'global' | 'nonlocal' ) IDENT { ',' IDENT }
  | 'import' dotted [ 'as' ident ] { ',' dotted [ 'as' ident ] } | 'from' ( { DOT } dotted | DOT { DOT } ) 'import' ( '*' | imps | '(' imps [ ',' ] ')' ) | 'type' ident '=' expr ;
imps = ident [ 'as' ident ] { ',' ident [ 'as' ident ] } ;
dotted = ident { DOT ident } ;
targets = tlist '=' ;
tlist = [ '*' ] target { ',' [ '*' ] target } [ ',' ] ;
target = ident | prim tail | '(' [ tlist ] ')' | '[' [ tlist ] ']' ;
tail = DOT ident | '[' subs ']' ;
yield = 'yield' [ 'from' expr | exprs ] ;
exprs = sexpr { ',' sexpr } [ ',' ] ;
sexpr = [ '*' ] expr ;
expr = 'lambda' [ lparams ] ':' expr | ident ':=' expr | or [ 'if' or 'else' expr ] ;
or = not { ( 'and' | 'or' ) not } ;
not = { 'not' } cmp ;
cmp = arith { ( '==' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' [ 'not' ] ) arith } ;
arith = unary { ( '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' | '<<' | '>>' | '&' | '|' | '^' ) unary } ;
unary = { '-' | '+' | '~' } [ 'await' ] prim ;
prim = atom { DOT ident | '(' [ arg { ',' arg } [ ',' ] ] ')' | '[' subs ']' } ;
subs = sub { ',' sub } [ ',' ] ;
sub = [ '*' ] expr | [ expr ] ':' [ expr ] [ ':' [ expr ] ] ;
arg = ( '*' | '**' ) expr | ident '=' expr | expr [ comp ] ;
atom = ident | NUM | STR { STR } | 'None' | 'True' | 'False' | '...' | '(' [ yield | sexpr comp | exprs ] ')' | '[' [ sexpr comp | exprs ] ']' | '{' [ ditem { ',' ditem } [ ',' ] | expr ':' expr comp | exprs | sexpr comp ] '}' ;
ditem = expr ':' expr | '**' or ;
comp = cfor { cfor | 'if' or } ;
cfor = [ 'async' ] 'for' tlist 'in' or ;
compound = [ 'async' ] 'def' ident [ '[' exprs ']' ] '(' [ params ] ')' [ '->' expr ] ':' suite | 'class' ident [ '(' [ arg { ',' arg } [ ',' ] ] ')' ] ':' suite | '@' expr NL { '@' expr NL } compound
  | 'if' expr ':' suite { 'elif' expr ':' suite } [ 'else' ':' suite ] | 'while' expr ':' suite [ 'else' ':' suite ] | [ 'async' ] 'for' tlist 'in' exprs ':' suite [ 'else' ':' suite ]
  | 'try' ':' suite ( 'except' [ [ '*' ] exprs [ 'as' ident ] ] ':' suite { 'except' [ [ '*' ] exprs [ 'as' ident ] ] ':' suite } [ 'else' ':' suite ] [ 'finally' ':' suite ] | 'finally' ':' suite )
  | [ 'async' ] 'with' ( witem { ',' witem } | '(' witem { ',' witem } [ ',' ] ')' ) ':' suite | 'match' exprs ':' NL INDENT 'case' exprs [ 'if' expr ] ':' suite { 'case' exprs [ 'if' expr ] ':' suite } DEDENT ;
witem = expr [ 'as' target ] ;
params = param { ',' param } [ ',' ] ;
param = '/' | '*' [ ident [ ':' expr ] ] | '**' ident [ ':' expr ] | ident [ ':' expr ] [ '=' expr ] ;
lparams = lparam { ',' lparam } [ ',' ] ;
lparam = '/' | '*' [ ident ] | '**' ident | ident [ '=' expr ] ;
ident = IDENT | 'match' | 'case' | 'type' ;
"""


class Language:
    """A token pattern, the class of each token, and a grammar over the classes.

    ``pattern`` must end with a branch for any other character, so nothing is skipped silently.
    """

    def __init__(self, grammar: str, pattern: str, keywords=(), *, start: str = "file", fold: bool = False, semicolons: str = "", groups=()):
        self.find = re.compile(pattern).findall
        self.keywords = frozenset(k.upper() if fold else k for k in keywords)
        self.fold, self.semicolons = fold, semicolons
        self.groups = tuple((re.compile(p), c) for p, c in groups)
        self.grammar = Grammar(grammar, start)
        self.known = set(re.findall(r"'([^']*)'", re.sub(r"(?m)^\s*--.*$", "", grammar)))
        self.cache: dict[str, int] = {}
        self.skip, self.newline = -1, -2

    def classify(self, tok: str) -> int:
        if tok in self.keywords:  # before the general class of names
            return self.grammar.token(tok)
        name = None
        for p, c in self.groups:
            if p.match(tok):
                name = c
                break
        if name == "SKIP":
            return self.skip
        if name == "LINE":
            return self.newline
        if name is None:
            word = tok.upper() if self.fold else tok
            name = word if word in self.keywords or tok in self.known else _BAD
        return self.grammar.token(name)

    def classes(self, text: str):
        cache, out = self.cache, []
        if len(cache) > 200_000:
            cache.clear()
        for tok in self.find(text):
            c = cache.get(tok)
            if c is None:
                c = self.classify(tok)
                if len(tok) < 80:
                    cache[tok] = c
            if c >= 0:
                out.append(c)
        return out

    def check(self, text: str) -> tuple[str, int]:
        return self.grammar.run(self.classes(text))


class LineLanguage(Language):
    """A language in which a line end can stand for a semicolon.

    ``enders``: classes after which one can stand; ``starters``: classes that continue a line.
    """

    def __init__(self, *args, enders=(), starters=(), **kw):
        super().__init__(*args, **kw)
        self.enders = frozenset(self.grammar.token(x) for x in enders)
        self.starters = frozenset(self.grammar.token(x) for x in starters)
        self.semi = self.grammar.token(";")

    def classes(self, text: str):
        cache, out, pending, prev = self.cache, [], False, -1
        if len(cache) > 200_000:
            cache.clear()
        enders, starters, semi, line = self.enders, self.starters, self.semi, self.newline
        for tok in self.find(text):
            c = cache.get(tok)
            if c is None:
                c = self.classify(tok)
                if len(tok) < 80:
                    cache[tok] = c
            if c >= 0:
                if pending:
                    pending = False
                    if c not in starters:
                        out.append(semi)
                out.append(c)
                prev = c
            elif c == line and prev in enders:
                pending = True
        if prev in enders:
            out.append(semi)
        return out


# A regular expression literal stands where no operand has just ended; strings, templates and comments are passed over.
_REGEX_LITERAL = re.compile(
    rf"({_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*`|{_C_COMMENT})"
    r"|((?:[(,=:\[!&|?{;+*%~^-]|\b(?:return|typeof|case|in|of|do|else|void|delete|throw|await|yield)\b|=>)\s*)(/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*)"
)
_MAY_HOLD_REGEX = re.compile(r"[(,=:\[!&|?{;+*%~^n>-]\s*/[^/*\s]")


class _Script(LineLanguage):
    """JavaScript and TypeScript: literals of regular expressions are read as strings."""

    def classes(self, text: str):
        if _MAY_HOLD_REGEX.search(text):
            text = _REGEX_LITERAL.sub(lambda m: m.group() if m.group(1) else m.group(2) + '"r"', text)
        return super().classes(text)


def _soft(names) -> str:
    return " | ".join(f"'{n}'" for n in names)


def _js(typed: bool) -> LineLanguage:
    soft = _TS_SOFT if typed else _JS_SOFT
    keys = _JS_KEYS + soft
    g = EXPR_JS + (TS_EXTRA if typed else JS_EXTRA)
    g += f"ident = IDENT | {_soft(soft)} ; anyname = IDENT | {_soft(keys)} ;"
    pattern = rf"\A#![^\n]*|\n|#?[A-Za-z_$][\w$]*|[ª-￿][\w$]*|{_NUM}n?[A-Za-z_$]*|{_DQ}|{_SQ}|`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|{_C_COMMENT}|=>|\.\.\.|\?\.(?!\d)|\?\?=?|===?|!==?|\*\*=?|\+\+|--|&&=?|\|\|=?|<<=?|<=|>=|[-+*/%&|^]=|[^\s\w]"
    groups = [(r"\n", "LINE"), _OPEN, (r"#!", "SKIP"), (r"//|/\*[\s\S]", "SKIP"), (rf"(?:{'|'.join(keys)})$", None), (r"#?[A-Za-z_$ª-￿][\w$]*$", "IDENT"), (rf"{_NUM}n?$", "NUM"), (r"[\"'].", "STR"), (r"`(?!(?s:.*)`\Z)", "ERROR"), (r"`", "TEMPLATE"), (r"(?:===?|!==?)$", "=="), (r"(?:[-+*/%&|^]|\*\*|&&|\|\||\?\?|<<)=$", "OPASSIGN")]
    groups = [(p, c) for p, c in groups if c]
    lang = _Script(
        g, pattern, keys, groups=groups,
        enders=["IDENT", "NUM", "STR", "TEMPLATE", ")", "]", "}", "++", "--", "this", "null", "true", "false", "return", "break", "continue", "super", *soft, *([">", "void"] if typed else [])],
        starters=[".", "?.", ",", ")", "]", "}", "?", ":", "=", "==", "&&", "||", "??", "|", "&", "^", "+", "-", "*", "/", "%", "**", "<", ">", "<<", "<=", ">=", "=>", "OPASSIGN", "in", "instanceof", "else", "catch", "finally", "(", "[", "TEMPLATE", ";", "{"],
    )
    return lang



def _go() -> LineLanguage:
    keys = "package import func for if return struct map var const range type switch case default break continue goto fallthrough go defer select chan interface else".split()
    pattern = rf"\n|[A-Za-z_]\w*|[ª-￿]\w*|{_NUM}i?[A-Za-z_]*|{_DQ}|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|{_C_COMMENT}|:=|\.\.\.|<-|==|!=|&\^=?|\+\+|--|&&|\|\||<<=?|>>=?|<=|>=|[-+*/%&|^]=|[^\s\w]"
    groups = [(r"\n", "LINE"), _OPEN, (r"//|/\*[\s\S]", "SKIP"), (r"[A-Za-z_ª-￿]\w*$", "IDENT"), (rf"{_NUM}i?$", "NUM"), (r"[\"`][\s\S]", "STR"), (r"'.", "CHAR"), (r"(?:==|!=)$", "=="), (r"(?:[-+*/%&|^]|<<|>>|&\^)=$", "OPASSIGN"), (r"&\^$", "&")]
    return LineLanguage(GO, pattern, keys, groups=groups, enders=["IDENT", "NUM", "STR", "CHAR", ")", "]", "}", "++", "--", "return", "break", "continue", "fallthrough"], starters=[])


def _rust() -> Language:
    keys = "use pub fn struct enum impl trait mod const static let mut if else match for in while loop return break continue self crate super where as type unsafe async await move dyn ref extern true false".split()
    raw = "|".join(rf'[bc]?r{h}"[\s\S]*?"{h}' for h in ("#####", "####", "###", "##", "#", ""))
    pattern = rf"{raw}|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|r#[A-Za-z_]\w*|(?:b)?'(?:[^'\\\n]|\\(?:x..|u\{{[0-9a-fA-F]+\}}|.))'|'[A-Za-z_]\w*|[A-Za-z_]\w*|\d[\d_]*(?:\.\d[\d_]*(?:[eE][-+]?\d+)?|\.(?![.\w]))?[A-Za-z_]?\w*|{_C_COMMENT}|::|->|=>|\.\.=|\.\.\.|\.\.|==|!=|&&|\|\||<=|>=|<<=|[-+*/%&|^]=|[^\s\w]"
    groups = [_OPEN, (r"//|/\*[\s\S]", "SKIP"), (r"[bc]?r#*\".|[bc]?\".|b?\"\"", "STR"), (r"r#[A-Za-z_]", "IDENT"), (r"b?'(?:[^'\\\n]|\\.+)'$", "CHAR"), (r"'[A-Za-z_]\w*$", "LIFETIME"), (r"[A-Za-z_]\w*$", "IDENT"), (r"(?:0x[0-9a-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][-+]?\d+)?)(?:_?[iuf](?:8|16|32|64|128|size))?$", "NUM"), (r"(?:==|!=)$", "=="), (r"(?:[-+*/%&|^]|<<)=$", "OPASSIGN")]
    plain = sorted(set(re.findall(r"'([^']+)'", RUST)) - {"(", ")", "[", "]", "{", "}"})
    any_tok = "anytok = IDENT | NUM | STR | CHAR | LIFETIME | OPASSIGN | '$' | '@' | " + _soft(plain) + " ;"
    return Language(RUST + any_tok, pattern, keys, groups=groups)


def _java() -> Language:
    keys = "package import static final default synchronized class interface enum record extends implements super throws void this if else for while do return throw break continue try catch finally switch case assert new instanceof true false null permits when".split()
    pattern = rf"non-sealed|[A-Za-z_$][\w$]*|[ª-￿]\w*|{_NUM}[A-Za-z_]*|\"\"\"[\s\S]*?\"\"\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]+?)'|{_C_COMMENT}|::|->|\.\.\.|==|!=|\+\+|--|&&|\|\||<<=?|<=|>=|[-+*/%&|^]=|[^\s\w]"
    groups = [_OPEN, (r"//|/\*[\s\S]", "SKIP"), (r"(?:public|private|protected|abstract|native|transient|volatile|strictfp|sealed|non-sealed)$", "MODIFIER"), (r"(?:int|long|short|byte|char|float|double|boolean)$", "PRIM"), (r"[A-Za-z_$ª-￿][\w$]*$", "IDENT"), (rf"{_NUM}[lLfFdD]?$", "NUM"), (r"\".|\"\"", "STR"), (r"'.", "CHAR"), (r"(?:==|!=)$", "=="), (r"(?:[-+*/%&|^]|<<)=$", "OPASSIGN")]
    g = re.sub(r"\bIDENT\b", "id", JAVA) + " id = IDENT | 'record' | 'permits' | 'when' ;"
    return Language(g, pattern, keys, groups=groups)


def _cpp() -> Language:
    keys = "namespace using typedef template typename class struct union enum extern static const inline friend auto decltype operator noexcept default delete if else for while do return break continue goto switch case try catch throw new sizeof this true false nullptr constexpr static_assert final".split()
    pattern = rf"(?m:^[ \t]*#(?:[^\n\\]|\\\r?\n|\\.)*)|[A-Za-z_]\w*|{_NUM}(?:[uUlLfFzZ]*)(?:_?[A-Za-z]\w*)?|R\"\w*\([\s\S]*?\)\w*\"|{_DQ}|'(?:[^'\\\n]|\\[^\n]+?)'|{_C_COMMENT}|::|->|\.\.\.|<=>|==|!=|\+\+|--|&&|\|\||<<=?|<=|>=|[-+*/%&|^]=|[^\s\w]"
    groups = [_OPEN, (r"//|/\*[\s\S]", "SKIP"), (r"[ \t]*#[ \t]*(?:(?:define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b|include\s*(?:<[^<>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)\s*(?://|/\*|$))|[ \t]*#\s*$", "SKIP"), (r"(?:public|private|protected)$", "ACCESS"), (r"(?:explicit|virtual|mutable|volatile|override|register|thread_local|consteval|constinit)$", "SPEC"), (r"(?:static_cast|dynamic_cast|const_cast|reinterpret_cast)$", "CAST"),
              (r"(?:int|long|short|char|float|double|bool|void|unsigned|signed|wchar_t|char8_t|char16_t|char32_t)$", "BUILTIN"), (r"R\"", "STR"), (r"[A-Za-z_]\w*$", "IDENT"), (rf"(?:{_NUM}|\d[\d']*)(?:[uUlLfFzZ]*)$", "NUM"), (r"\".|\"\"", "STR"), (r"'.", "CHAR"), (r"(?:==|!=)$", "=="), (r"(?:[-+*/%&|^]|<<)=$", "OPASSIGN")]
    g = CPP.replace("spec = SPEC", "spec = SPEC | 'constexpr'")
    return _Cpp(g, pattern, keys, groups=groups)


# A line of nothing but a macro's name stands for what only the preprocessor knows.
_MACRO_LINE = re.compile(r"(?m)^[ \t]*[A-Z][A-Z0-9]*_[A-Z0-9_]+[ \t]*\r?$")


class _Cpp(Language):
    def classes(self, text: str):
        return super().classes(_MACRO_LINE.sub("", text))


class _Folded(Language):
    def classify(self, tok: str) -> int:
        if tok.upper() in self.keywords:
            return self.grammar.token(tok.upper())
        return super().classify(tok)


def _sql() -> Language:
    keys = sorted({k for k in re.findall(r"'([A-Z]+)'", SQL)})
    pattern = r"[A-Za-z_]\w*|\d[\w.]*|'(?:[^'\\]|''|\\.)*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|::|<>|!=|<=|>=|\|\||[^\s\w]"
    groups = [_OPEN, (r"--|/\*[\s\S]", "SKIP"), (r"[A-Za-z_]\w*$|[\"`].", "NAME"), (r"\d+(?:\.\d*)?(?:[eE][-+]?\d+)?$", "NUM"), (r"'.", "STR"), (r"(?:<>|!=|<=|>=|<|>)$", "CMP")]
    return _Folded(SQL, pattern, keys, fold=True, groups=groups)


def _bash() -> Language:
    keys = "if then fi for do done while until case esac in else elif function select time ! { }".split()
    inner = r"(?:[^()\"'\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*"
    part = rf"(?:[^\s;&|<>()\"'`$\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|\$?'[^']*'|\$\({inner}\)|\$\{{(?:[^{{}}\"']|\"[^\"]*\"|'[^']*'|\$\{{[^}}]*\}})*\}}|\$(?![({{'])|`[^`]*`)"
    pattern = rf"\n|(?<![^\s;&|()])#[^\n]*|<<-?\s*(?:\\?[A-Za-z_]\w*|'\w+'|\"\w+\")[\s\S]*?(?=\n)|\[\[[ \t\n][\s\S]*?[ \t\n]\]\]|\(\((?:[^()]|\([^()]*\))*\)\)|\d*>&\d|\d*>&-|&>>?|\d*(?:>>|>\||>|<<<|<>|<)|(?:[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=\((?:[^()\"']|\"[^\"]*\"|'[^']*'|\$\([^()]*\))*\))|{part}+|\|\||&&|;;&?|;&|\|&|[^\s]"
    groups = [(r"\n", "NL"), (r"#", "SKIP"), (r"\[\[[ \t\n]", "TEST"), (r"\(\(", "ARITH"), (r"\d*>&[\d-]$", "REDIRDUP"), (r"<<-?\s*['\"\\\w]", "HEREDOC"), (r"(?:&>>?|\d*(?:>>|>\||>|<<<|<>|<))$", "REDIR"), (r"[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=\(", "ARRAY"), (r"(?:\|\||&&|;;&?|;&|\|&|[;&|()\"'`])$", None), (rf"{part}+$", "WORD")]

    class Bash(Language):
        def classify(self, tok: str) -> int:
            if tok in ("||", "&&", ";;", ";;&", ";&", "|&", ";", "&", "|", "(", ")"):
                return self.grammar.token(";;" if tok == ";;&" else tok)
            return super().classify(tok)

        def check(self, text: str) -> tuple[str, int]:
            return super().check(_drop_heredocs(text.replace("\r\n", "\n").replace("\\\n", " ")))

    return Bash(BASH, pattern, keys, groups=[(p, c) for p, c in groups if c])


_HEREDOC = re.compile(r"<<(-?)[ \t]*(['\"]?)\\?([A-Za-z_]\w*)\2")


def _drop_heredocs(text: str) -> str:
    if "<<" not in text:
        return text
    out, ends = [], []
    for line in text.split("\n"):
        if ends:
            if (line.lstrip("\t") if ends[0][0] else line).rstrip() == ends[0][1]:
                ends.pop(0)
            continue
        out.append(line)
        if not line.lstrip().startswith(("#", "<<<<<<<")):
            ends += [(m.group(1), m.group(3)) for m in _HEREDOC.finditer(line) if not line[m.start() - 1 : m.start()] == "<" and not line[m.end() - 1 :].startswith("<")]
    return "\n".join(out) + ('\n"' if ends else "")


def _json() -> Language:
    pattern = r"[A-Za-z_]\w*|-?\d[\w.+-]*|\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|\S"
    groups = [(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?$", "NUM"), (r"\".|\"\"", "STR")]
    return Language(JSON, pattern, "true false null".split(), groups=groups)


class _Yaml(Language):
    """YAML by lines: each line gives the class of its content, indentation gives INDENT and DEDENT."""

    _LINE = re.compile(r"^(?P<i>[ ]*)(?P<d>(?:- +)*-?(?= |$) *|)(?:(?P<k>\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[^\s\"'#&*!|>%@`{}\[\],:?-][^#:\n{}\[\]]*?|[^\s\"'#&*!|>%@`{}\[\],]+?) *:(?: +(?P<v>.*))?|(?P<s>.*))$")

    def check(self, text: str) -> tuple[str, int]:
        t = self.grammar.token
        out, stack, block = [], [0], -1
        first = True
        for raw in text.replace("\r\n", "\n").split("\n"):
            if not raw.strip():
                continue
            depth = len(raw) - len(raw.lstrip(" "))
            if block >= 0:
                if depth > block:
                    continue
                block = -1
            body = raw.rstrip()
            if body.lstrip().startswith("#"):
                continue
            if body.startswith(("---", "...")) and (len(body) == 3 or body[3] == " "):
                if body.startswith("... ") and not body[3:].lstrip().startswith("#"):
                    return "token", len(out)
                out += [t("DEDENT")] * (len(stack) - 1) + [t("DOC")]
                stack = [0]
                if len(body) > 3:
                    out += [t("SCALAR")]
                continue
            if body.startswith("%") and first:
                continue
            if "\t" in raw[: len(raw) - len(raw.lstrip())] or body.lstrip()[:1] in ("`", "@", "%"):
                return "token", len(out)
            first = False
            m = self._LINE.match(body)
            if not m:
                return "token", len(out)
            dash, key, val, scalar = m.group("d").rstrip(), m.group("k"), m.group("v"), m.group("s")
            if depth > stack[-1]:
                stack.append(depth)
                out.append(t("INDENT"))
            while depth < stack[-1]:
                stack.pop()
                out.append(t("DEDENT"))
            if depth != stack[-1]:
                return "token", len(out)
            if dash.count("-") > 1:
                key, val, scalar = None, None, "x"
            if key is not None:
                v = _yaml_value(val)
                if v is None:
                    return "token", len(out)
                if dash:
                    out.append(t({"": "ITEMKEY", "|": "ITEMKEYVAL", "x": "ITEMKEYVAL"}[v]))
                    if v == "|":
                        block = depth + 2
                else:
                    out.append(t({"": "KEY", "|": "BLOCKKEY", "x": "KEYVAL"}[v]))
                    if v == "|":
                        block = depth
            else:
                v = _yaml_value(scalar)
                if v is None:
                    return "token", len(out)
                if v == "|":
                    block = depth
                out.append(t(("DASH" if v == "" else "BLOCKITEM" if v == "|" else "ITEM") if dash else "SCALAR"))
                if not dash and v == "x" and scalar[:1] not in "\"'{[" and re.search(r"^[<>=]{7}|^\|{7}", scalar):
                    return "token", len(out)
        out += [t("DEDENT")] * (len(stack) - 1)
        return self.grammar.run(out)


_FLOW = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'|[{}\[\]]|[^\"'{}\[\]]+|.")


def _yaml_value(v: str | None) -> str | None:
    """``""`` for none, ``"|"`` for a block scalar, ``"x"`` for a value, None for a broken one."""
    v = (v or "").strip()
    if not v or v[0] == "#":
        return ""
    while v[:1] in "&!" and v:
        v = v.partition(" ")[2].strip()
    if not v:
        return ""
    if v[0] in "|>":
        return "|" if re.fullmatch(r"[|>][-+\d]*(?:\s+#.*)?", v) else None
    if v[0] in "\"'":
        m = re.match(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'", v)
        return "x" if m and re.fullmatch(r"\s*(?:#.*)?", v[m.end() :]) else None
    if v[0] in "{[":
        opened = []
        for tok in _FLOW.findall(v):
            if tok in ("{", "["):
                opened.append("}" if tok == "{" else "]")
            elif tok in ("}", "]"):
                if not opened or opened.pop() != tok:
                    return None
            elif tok in ("\"", "'"):
                return None
        return None if opened else "x"
    if v[0] in "@`%,]}" or v[:2] in ("- ", "? "):
        return None
    v = re.split(r"\s#", v)[0]
    return None if re.search(r":(?:\s|$)", v) else "x"


class _Python(Language):
    def classes(self, text: str):
        t = self.grammar.token
        cache, out = self.cache, []
        if len(cache) > 200_000:
            cache.clear()
        nl, indent, dedent, bad = t("NL"), t("INDENT"), t("DEDENT"), t(_BAD)
        opens, closes = self.opens, self.closes
        depth, stack, fresh = 0, [0], True
        pad = ""
        for tok in self.find("\n" + text):
            if tok[0] == "\n":
                if not depth:
                    if not fresh:
                        out.append(nl)
                        fresh = True
                    pad = tok[tok.rfind("\n") + 1 :]
                continue
            c = cache.get(tok)
            if c is None:
                c = self.classify(tok)
                if len(tok) < 80:
                    cache[tok] = c
            if c < 0:
                continue
            if fresh:
                fresh = False
                w = len(pad.expandtabs(8)) if "\t" in pad else len(pad)
                if w > stack[-1]:
                    stack.append(w)
                    out.append(indent)
                else:
                    while w < stack[-1]:
                        stack.pop()
                        out.append(dedent)
                    if w != stack[-1]:
                        out.append(bad)
            if c in opens:
                depth += 1
            elif c in closes and depth:
                depth -= 1
            out.append(c)
        if not fresh:
            out.append(nl)
        out += [dedent] * (len(stack) - 1)
        return out


def _python() -> Language:
    keys = "pass break continue return raise from assert del global nonlocal import as lambda if else and or not in is await None True False yield for async def class elif while try except finally with match case type".split()
    q = r"(?:[rRbBuUfF]{1,2})?"
    triple = rf"{q}\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|{q}'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)"
    pattern = rf"\n[ \t\f]*|\\\r?\n|#[^\n]*|{triple}|{q}\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|{q}'(?!'')(?:[^'\\\n]|\\[\s\S])*'|{_NUM}[jJ]?\w*|[A-Za-z_]\w*|[ª-￿]\w*|\.\.\.|:=|->|\*\*=?|//=?|<<=?|>>=?|==|!=|<=|>=|[-+*/%@&|^]=|[^\s\w]"
    groups = [(r"#|\\\r?\n", "SKIP"), (r"(?:[rRbBuUfF]{1,2})?(?:\"\"\"(?!(?s:.*)\"\"\"\Z)|'''(?!(?s:.*)'''\Z))", "ERROR"), (r"(?:[rRbBuUfF]{1,2})?[\"'](?=.)", "STR"), (rf"(?:{_NUM})[jJ]?$", "NUM"), (r"[A-Za-z_ª-￿]\w*$", "IDENT"), (r"\.$", "DOT"), (r"(?:==|!=)$", "=="), (r"(?:[-+*/%@&|^]|\*\*|//|<<|>>)=$", "OPASSIGN")]

    lang = _Python(PYTHON, pattern, keys, groups=groups)
    lang.opens = frozenset(lang.grammar.token(x) for x in "([{")
    lang.closes = frozenset(lang.grammar.token(x) for x in ")]}")
    return lang


_MAKERS = {
    "python": _python, "javascript": lambda: _js(False), "typescript": lambda: _js(True), "go": _go, "rust": _rust, "java": _java, "cpp": _cpp, "bash": _bash, "sql": _sql, "json": _json,
    "yaml": lambda: _Yaml(YAML, r"\S"),
}
_MADE: dict[str, Language] = {}


def language(name: str) -> Language | None:
    if name not in _MAKERS:
        return None
    if name not in _MADE:
        _MADE[name] = _MAKERS[name]()
    return _MADE[name]
